"""Alignment of two tokenizers' tokens over whole texts.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a SentencePiece model.
Both read a space and the text (B adds the space itself), special tokens being plain text,
and every token is a run of bytes of that.  Byte offsets where a token of A and one of B
end together cut a text into groups; a token of A and one of B are linked if their bytes
overlap; a pair of ids counts how many links of the whole corpus join the two.

The work is an Arrow pipeline over runs of texts:

* lists of ids are flattened, with the parent index of each token;
* token lengths are summed cumulatively and, by document, from its own start;
* an Acero hash join on (document, end) finds the ends that both tokenizers share;
* linked ids become pairs, counted by ``Table.group_by`` once per block of texts.

Spark merges these partial counts, finds the highest count of every id of B, and sends each
block the counts of its own distinct pairs, which close its documents' sums.  Texts are
encoded once: a block keeps its links as places in its list of pairs, packed.  Blocks are
cut by bytes of text (a longer text is a block of its own), so nothing a task holds grows
with the corpus, and a pair that is in all texts comes once per block.

Encoding: both libraries treat the pieces between certain cuts independently (A the matches
of its pre-tokenizer's pattern; B runs of spaces with what follows, as no piece of the model
holds a space behind another character), so each distinct piece is given to the library once
and then remembered.  A model without that property gets its texts whole.

Cases: null and empty texts have no tokens, nor have texts whose tokens of A or of B don't
join to the bytes of space and text (a model that normalises, or a U+2581 in the text):
counts and sums are 0 and the groups ''.  Ids may have any type; rows of one id, repeated
rows and null ids each get their row.  Ties for the highest count all count as best.  Other
columns of the input, whatever their names, are neither read nor returned.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayline.llm.bpe import BYTE_LEVEL_PATTERN, byte_letters, read_spec
from quayline.llm.packing import pack, unpack
from quayline.llm.tables import Steps, give_back, read_table

#: Bytes of text that are aligned at once, and that make a block.
RUN_BYTES = 1 << 20
BLOCK_BYTES = 12 << 20
#: Pieces that a worker remembers per tokenizer.
REMEMBERED = 500_000
#: What a vocabulary of SentencePiece writes for a space.
SPACE_MARK = "\u2581"


class Remembering:
    """Ids of texts through a library that is asked once for each distinct piece."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.pieces(text) for text in texts]
        new = list(set().union(*split).difference(self.known))
        for piece, ids in zip(new, self.library_ids(new), strict=True):
            self.known[piece] = array("i", ids).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


class ByteLevel(Remembering):
    """Tokenizer A, from the text of its file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        read = json.loads(spec)
        before = read["pre_tokenizer"] or {}
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        alone = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not read["normalizer"]
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN if alone else r"(?s).+").findall
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        names = {i: name for name, i in self.library.get_vocab(with_added_tokens=True).items()}
        spelled = [names.get(i, "") for i in range(max(names) + 1)]
        self.bytes = pa.array([bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s in spelled], pa.binary())

    def library_ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class SentencePiece(Remembering):
    """Tokenizer B, from the bytes of its model; it adds the space before the text."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.library = SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        alone = not any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in names)
        self.pieces = re.compile(r" *[^ ]+| +" if alone else r"(?s).+").findall
        self.space = self.library.piece_to_id(SPACE_MARK)
        self.bytes = pa.array([self._bytes(i, name) for i, name in enumerate(names)], pa.binary())

    def _bytes(self, i: int, name: str) -> bytes:
        return bytes([int(name[3:5], 16)]) if self.library.is_byte(i) else name.replace(SPACE_MARK, " ").encode()

    def library_ids(self, pieces: list[str]) -> list[list[int]]:
        made = self.library.encode([p[1:] for p in pieces], num_threads=1) if pieces else []
        return [ids if len(p) > 1 else [self.space] for p, ids in zip(pieces, made, strict=True)]


ENCODERS: dict[int, tuple[ByteLevel, SentencePiece]] = {}


def encoders(spec: str, model: bytes) -> tuple[ByteLevel, SentencePiece]:
    """One pair per worker, so that its tasks share what is remembered."""
    key = hash((spec, model))
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = ByteLevel(spec), SentencePiece(model)
    return ENCODERS[key]


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def faithful(lists: pa.ListArray, vocabulary: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each list's tokens are the text."""
    taken = vocabulary.take(pc.list_flatten(lists))
    data = memoryview(taken.buffers()[2] or b"").cast("B")
    ends = np.frombuffer(taken.buffers()[1], np.int32)[lists.offsets.to_numpy()] if len(taken) else np.zeros(len(lists) + 1, int)
    return np.array([data[a:b] == text for a, b, text in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)], bool)


def token_ends(lists: pa.ListArray, vocabulary: pa.Array) -> pa.Table:
    """Of every token its list (doc), the offset of its end there, its place among all
    tokens, and the bytes of all tokens up to it (total)."""
    doc = pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(vocabulary).take(pc.list_flatten(lists)), pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total])
    start = before.take(lists.offsets.slice(0, len(lists)))
    return pa.table({"doc": doc, "end": pc.subtract(total, start.take(doc)), "place": np.arange(len(doc)), "total": total})


def shared_ends(a: pa.Table, b: pa.Table) -> list[np.ndarray]:
    """Places of the tokens of A and of B that end together, both in order.

    The texts have as many bytes on both sides, so bytes so far and texts so far tell the
    text and the offset, and their sum ascends: sorted numbers are searched, none hashed.
    """
    keys = [t["total"].to_numpy() + t["doc"].to_numpy() for t in (a, b)]
    out = []
    for own, other in (keys, keys[::-1]):
        at = np.searchsorted(other, own)
        out.append(np.flatnonzero(np.append(other, -1)[at] == own))
    return out


def links(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and of B of every overlapping pair, in order.

    A token of A meets the tokens of B from the one that holds its first byte to the one
    that holds its last.
    """
    ends, others = a["total"].to_numpy(), b["total"].to_numpy()
    last = np.searchsorted(others, ends)
    first = np.zeros(len(ends), np.int64)
    first[1:] = last[:-1] + (others[last[:-1]] == ends[:-1])
    each = last - first + 1
    before = np.cumsum(each) - each
    return np.repeat(np.arange(len(ends)), each), np.arange(each.sum()) - np.repeat(before - first, each)


def group_texts(lists: list[pa.ListArray], last: list[np.ndarray], per_doc: np.ndarray) -> pa.Array:
    """Per document ``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    sides = []
    for some, ends in zip(lists, last, strict=True):
        cuts = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
        sides.append(pc.binary_join(pa.ListArray.from_arrays(cuts, pc.cast(pc.list_flatten(some), pa.string())), ","))
    both = pc.binary_join_element_wise(*sides, "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), both), ";")


class Block:
    """Aligned texts until they are enough for one row."""

    def __init__(self):
        self.size, self.columns, self.pairs = 0, {c: [] for c in DOCUMENT}, []

    def add(self, ids: pa.Array, texts: list[str | None], a: ByteLevel, b: SentencePiece, keep_groups: bool) -> None:
        spaced = [" " + t if t else "" for t in texts]
        raw = [t.encode() for t in spaced]
        self.size += sum(map(len, raw)) + 16 * len(raw)
        encoded = [one.encode(spaced) for one in (a, b)]
        fine = [faithful(id_lists(e), one.bytes, raw) for e, one in zip(encoded, (a, b), strict=True)]
        fine = fine[0] & fine[1]
        lists = [id_lists([e if f else b"" for e, f in zip(some, fine.tolist(), strict=True)]) for some in encoded]
        ends = [token_ends(some, one.bytes) for some, one in zip(lists, (a, b), strict=True)]
        last = shared_ends(*ends)
        per_doc = np.bincount(ends[0]["doc"].to_numpy()[last[0]], minlength=len(texts))
        left, right = links(*ends)
        names = [pc.list_flatten(some).to_numpy().astype(np.int64) for some in lists]
        self.pairs.append(names[0][left] << 32 | names[1][right])
        groups = group_texts(lists, last, per_doc).to_pylist()
        made = {
            "id": ids.to_pylist(), "n_a": pc.list_value_length(lists[0]).to_pylist(), "n_b": pc.list_value_length(lists[1]).to_pylist(),
            "n_groups": per_doc.tolist(), "n_links": np.bincount(ends[0]["doc"].to_numpy()[left], minlength=len(texts)).tolist(),
            "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
            "groups": groups if keep_groups else [None] * len(groups),
        }
        for name, values in made.items():
            self.columns[name] += values

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """All documents, the distinct pairs with their counts, and every link as the
        place of its pair."""
        coded = pa.array(np.concatenate(self.pairs)).dictionary_encode()
        counted = pa.table({"place": coded.indices}).group_by("place", use_threads=False).aggregate([([], "count_all")])
        counts = np.zeros(len(coded.dictionary), np.int64)
        counts[counted["place"].to_numpy()] = counted["count_all"].to_numpy()
        values = {"block": number, **self.columns, "pairs": coded.dictionary, "counts": counts, "links": pack(coded.indices.to_numpy())}
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)


DOCUMENT = {
    "id": None, "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "groups": "string",
}


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (id, text) of about RUN_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + RUN_BYTES)))
        yield batch.slice(start, end - start)
        start = end


def aligned_blocks(docs: DataFrame, spec: str, model: bytes, keep_groups: bool) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{name} array<{of or kind}>" for name, of in DOCUMENT.items())
    fields = StructType.fromDDL(f"block long, {columns}, pairs array<long>, counts array<long>, links binary")
    arrow = to_arrow_schema(fields)

    def run(batches):
        a, b = encoders(spec, model)
        first, made, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for some in runs(batch):
                block.add(some.column(0), some.column(1).to_pylist(), a, b, keep_groups)
                if block.size >= BLOCK_BYTES:
                    yield block.row(first + made, arrow)
                    made, block = made + 1, Block()
                    give_back()
        if block.pairs:
            yield block.row(first + made, arrow)
        give_back()

    return docs.select("id", "text").mapInArrow(run, fields)


def closed_blocks(blocks: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """One row per document, with the sums that need the counts of the whole corpus."""
    names = [*DOCUMENT, "n_best", "count_sum"]
    types = {name: of or kind for name, of in DOCUMENT.items()} | {"n_best": "long", "count_sum": "long"}
    schema = StructType.fromDDL(", ".join(f"{name} {types[name]}" for name in names))

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.Table.from_batches([], to_arrow_schema(schema))
        places = unpack(left["links"][0].as_py(), np.int32)
        count, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        at = right["place"].to_numpy()
        count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        columns = {name: left[name].chunk(0).flatten() for name in DOCUMENT}
        ends = np.cumsum(np.concatenate([[0], columns["n_links"].to_numpy()]))
        for name, of in (("n_best", best), ("count_sum", count)):
            sums = np.concatenate([[0], np.cumsum(of[places])])
            columns[name] = pa.array(sums[ends[1:]] - sums[ends[:-1]])
        return pa.table(columns)

    left = blocks.select("block", *DOCUMENT, "links").groupBy("block")
    return left.cogroup(answers.groupBy("of")).applyInArrow(close, schema)


def align(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs.

    Per document: the id column, n_a, n_b, n_groups, n_links, groups_sha256, n_best,
    count_sum and (null unless asked for) the ``groups`` themselves, as ``a1,a2|b1;...``.
    Per linked pair of ids: a, b, count, and whether that is b's highest (best).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with open(tokenizer_b, "rb") as file:
        model = file.read()
    steps = Steps(docs.sparkSession, "alignment")
    blocks = steps.write(aligned_blocks(docs, read_spec(tokenizer_a), model, groups), "blocks")
    parts = blocks.select(F.inline(F.arrays_zip("pairs", "counts")))
    totals = parts.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count"))
    totals = steps.write(totals.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "totals")
    highest = totals.groupBy("b").agg(F.max("count").alias("most"))
    counted = totals.join(highest, "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counted, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    found = closed_blocks(blocks, answers, docs.schema["id"].dataType.simpleString()).withColumnRenamed("id", id_col)
    return found, counted.select(F.shiftright("pair", 32).alias("a"), "b", "count", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    found, _ = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("groups")
