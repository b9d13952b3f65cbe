"""Token ids as Parquet files: list columns in order of the document id.

The format, per document one row:

    doc_id    long, delta-encoded
    part      int, the file's place in the whole order, dictionary-encoded
    first     long, ids before this document within its part, delta-encoded
    n_tokens  long, with the end id
    ids       list<int>, dictionary-encoded while the vocabulary fits a dictionary page

Rows ascend by doc_id within a part and from part to part, so the start of a document
in the whole corpus is ``first`` plus the sizes of all earlier parts.  Row groups and
pages are small and carry page indexes: a reader of some documents skips the pages of
all others, a reader of metadata never touches the ids.

Cases: null text is written as empty text, with its end id alone.  Null ids come first,
repeated ids stand side by side in the order of their texts; empty input gives no rows.
Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.llm.bpe import LONGEST_WORD, Pieces, read_spec
from quayline.llm.hashing import LETTER, SPACE, U, mix, range_hashes
from quayline.llm.tables import map_batches, read_table
from quayline.session import run_folder


#: Words remembered per worker, a bound that only saves work, and the bytes of text that
#: are looked up at once.
MOST_KNOWN = 1_000_000
SLAB = 4 << 20
#: Bytes that are hashed at once, so that the numbers on the way stay in the processor's cache.
HASHED = 1 << 16
#: Another random number for each byte, for a second hash of each word.
OTHER = mix(np.arange(1 << 20, (1 << 20) + 256, dtype=U))


def two_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word data[start:end]."""
    names, checks, k = np.zeros(len(starts), U), np.zeros(len(starts), U), 0
    while k < len(starts):
        a = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, a + HASHED, side="right")))
        part, s, e = data[a : ends[to - 1]], starts[k:to] - a, ends[k:to] - a
        names[k:to], checks[k:to] = range_hashes(LETTER[part], s, e), range_hashes(OTHER[part], s, e)
        k = to
    return names, checks


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column in one run of bytes, and where each begins and ends;
    null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class LibraryEncoder(Pieces):
    """The tokenizers library's model over the pieces of whole texts.

    Pieces are encoded independently of each other, so each is given to the library
    once and then remembered.  Where words between white space can be encoded one by one,
    ``encode_column`` looks all words of many texts up at once, by two 64-bit hashes in
    sorted arrays, and only unknown words are encoded.
    """

    def _read_model(self, model: dict, spec_text: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec_text).model
        self.forget()

        # Bytes read as Latin-1, to their letters; pieces are told apart by line ends.
        self.spelling = {b: c for b, c in enumerate(self.letters) if b != 0x0A}

    def _encode_piece(self, piece: str) -> bytes:
        letters = self.letters
        spelled = "".join([letters[b] for b in piece.encode("utf-8", "replace")])
        return array("I", [t.id for t in self.library.tokenize(spelled)]).tobytes()

    def _encode_new(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space of ASCII; what each needs is done for
        all of them at once."""
        text = "\n".join(words)
        plain = not any(t in text for t in self.added) and not any(unicodedata.category(c) == "Cn" for c in set(text))
        if not words or not plain:
            return [self._encode_text(w) for w in words]
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        cut = self.pattern.findall
        pieces = [(w,) if w.isalpha() else cut(w) for w in text.split("\n")]
        new = [p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in self.pieces]
        if new:
            spelled = "\n".join(new).encode("utf-8", "replace").decode("latin-1").translate(self.spelling).split("\n")
            for p, found in zip(new, map(self.library.tokenize, spelled), strict=True):
                self.pieces[p] = array("I", [t.id for t in found]).tobytes()
        find = self.pieces.__getitem__
        made = [find(p[0]) if len(p) == 1 else b"".join(map(find, p)) for p in pieces]
        for p in new:
            if len(p) > LONGEST_WORD:
                del self.pieces[p]
        return made

    def forget(self) -> None:
        self.names, self.checks = np.zeros(0, U), np.zeros(0, U)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in one array, and how many each text has."""
        self.trim()
        if not self.by_word:
            parts = [self.encode(t) for t in column.to_pylist()]
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        data, offsets = column_bytes(column)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        ids, sizes, borders, done = [], [], [], 0
        while done < len(data):
            end = min(done + SLAB, len(data))
            while end < len(data) and not begins[end] and not SPACE[data[end]]:
                end += 1
            slab, first = data[done:end], begins[done : end + 1]
            inside = ~SPACE[slab]
            starts = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
            ends = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1
            found, counts = self._encode_words(slab, starts, ends)
            ids.append(found)
            sizes.append(counts)
            borders.append(starts + done)
            self.pieces.trim()
            done = end
        if not ids:
            return np.zeros(0, "<u4"), np.zeros(len(column), np.int64)
        before = np.append(0, np.cumsum(np.concatenate(sizes)))
        return np.concatenate(ids), np.diff(before[np.searchsorted(np.concatenate(borders), offsets)])

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[start:end] in one array, and how many each word has."""
        names, checks = two_hashes(data, starts, ends)
        known, place = np.unique(names, return_inverse=True)
        one = np.zeros(len(known), np.int64)
        one[place] = np.arange(len(names))
        raw = data.tobytes()
        if (checks[one][place] != checks).any():  # unlike words of one name
            made = self._encode_new([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            return np.frombuffer(b"".join(made), "<u4"), np.array([len(m) // 4 for m in made], np.int64)
        checks = checks[one]
        at = np.searchsorted(self.names, known)
        hit = at < len(self.names)
        hit[hit] = (self.names[at[hit]] == known[hit]) & (self.checks[at[hit]] == checks[hit])
        new = np.flatnonzero(~hit)
        made = self._encode_new([raw[a:b].decode() for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
        new_sizes, new_ids = np.array([len(m) // 4 for m in made], np.int64), np.frombuffer(b"".join(made), "<u4")
        begin, size = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        begin[hit], size[hit] = self.starts[at[hit]], self.sizes[at[hit]]
        begin[new], size[new] = len(self.ids) + np.cumsum(new_sizes) - new_sizes, new_sizes
        store, counts = np.concatenate([self.ids, new_ids]), size[place]
        out = store[np.repeat(begin[place] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]

        short = (ends - starts)[one[new]] <= LONGEST_WORD
        if len(self.names) + short.sum() > MOST_KNOWN:
            self.forget()
        rows = new[short]
        into = np.searchsorted(self.names, known[rows])
        sizes, kept = new_sizes[short], new_ids[np.repeat(short, new_sizes)]
        self.starts = np.insert(self.starts, into, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, into, sizes)
        self.names, self.checks = np.insert(self.names, into, known[rows]), np.insert(self.checks, into, checks[rows])
        self.ids = np.concatenate([self.ids, kept])
        return out, counts


ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(spec_text: str) -> LibraryEncoder:
    """One encoder per worker and file, so that tasks share its memory of words."""
    if spec_text not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[spec_text] = LibraryEncoder(spec_text)
    return ENCODERS[spec_text]


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 1_000,
) -> None:
    """Encode every text and write it to ``folder`` in the format above."""
    spec = read_spec(tokenizer)
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def make():
        encoder, part, before = library_encoder(spec), TaskContext.get().partitionId(), 0

        def one(batch: pa.RecordBatch) -> dict:
            nonlocal before
            ids, counts = encoder.encode_column(batch.column(1))
            if end_id is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.concatenate([[0], np.cumsum(counts)])
            first = before + ends[:-1]
            before += int(ends[-1])
            ids = pa.array(ids.view("<i4"), pa.int32())
            return {
                "doc_id": batch.column(0), "part": pa.array(np.full(len(counts), part, np.int32)), "first": pa.array(first),
                "n_tokens": pa.array(counts), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
            }

        return one

    rows = map_batches(ordered, ["doc_id", "text"], "doc_id long, part int, first long, n_tokens long, ids array<int>", make)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#first", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(folder)
    )


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the files.  Spark reads only the columns that are asked for, and of
    a range of doc_id only the pages that hold it."""
    return spark.read.schema("doc_id long, part int, first long, n_tokens long, ids array<int>").parquet(folder)


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, part_start: the ids in all earlier parts.  One row per file."""
    sizes = token_rows(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("part_start"))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens: where each document lies, without reading ids."""
    rows = token_rows(spark, folder).select("doc_id", "part", "first", "n_tokens")
    return rows.join(part_starts(spark, folder), "part").select(
        "doc_id", (F.col("part_start") + F.col("first")).alias("start"), "n_tokens"
    )


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all taken from the ids in the files."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            return {
                "doc_id": batch.column(0), "part": batch.column(1), "first": batch.column(2),
                "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
            }

        return one

    schema = "doc_id long, part int, first long, n_tokens long, ids_crc32 long"
    rows = map_batches(token_rows(spark, folder), ["doc_id", "part", "first", "ids"], schema, make)
    return rows.join(part_starts(spark, folder), "part").select(
        "doc_id", (F.col("part_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = run_folder(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, folder)
