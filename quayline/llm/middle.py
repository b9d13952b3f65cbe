"""Fill-in-the-middle transformation by secondary sort.

A text is cut at two places into prefix, middle and suffix, and written in another order
with marks before each, so that a model learns to fill the middle in.  Where it is cut and
which form it takes follows from a hash of the seed and the document's id alone:

    plain  the text as it is
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

No task ever builds a whole output.  Every document is emitted as pieces of at most
``chunk`` code points, keyed by document and place in the output; the pieces are
repartitioned by document and sorted within partitions (the DataFrame form of
``repartitionAndSortWithinPartitions``), so each task reads the output of one document after
the other as a stream and digests it piece by piece.  For restoration the stream is parsed
by its marks alone and its pieces get their places in the original; sorted by these, within
the partitions they already lie in and so without another shuffle, they stream by in the
order of the text.  ``transformed`` and ``restore`` give whole texts, a document at a time.

Cases: null is taken as empty; an empty text, and one that holds a mark, is plain; plain
rows have null ``prefix_chars`` and ``middle_chars``.  A null id is hashed as no digits.
Repeated rows are told apart by task and count, so each gets its row, all alike; the same
holds for rows of one id and unlike texts.  Texts of any length are cut whole; code points
outside the basic plane count as one.  Other columns of the input, whatever their names,
are neither read nor returned.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayline.llm.tables import bucket_count, map_batches, read_table

MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
#: Sections of a form in order of output, and of the text.
ORDER = {"psm": "PSM", "spm": "SPM"}
TEXT_ORDER = "PMS"
#: Code points in a piece; characters in an Arrow batch of pieces; input bytes per task.
CHUNK = 16_384
BATCH_CHARS = 2_000_000
TASK_BYTES = 16 << 20

KEY = "name long, copy long, place long"
HEAD = "n long, form string, prefix_chars long, middle_chars long"


def plan(doc_id, text: str, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> tuple[str, int, int]:
    """The form of a document, and where its prefix and its middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(mark in text for mark in MARKS.values()) or h3 % 100 >= 100 - plain_percent:
        return "plain", len(text), len(text)
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < spm_percent else "psm"), first, second


def output_pieces(text: str, form: str, first: int, second: int, chunk: int) -> Iterator[str]:
    """The output in pieces of at most ``chunk`` code points; marks are pieces of their own."""
    if form == "plain":
        first = second = len(text)
    spans = {"P": (0, first), "M": (first, second), "S": (second, len(text))}
    for section in ORDER.get(form, "P"):
        if form != "plain":
            yield MARKS[section]
        start, end = spans[section]
        for at in range(start, end, chunk):
            yield text[at : min(end, at + chunk)]


class Restorer:
    """Reads an output as a stream and gives its pieces with their section of the text.

    No section holds a mark, and a mark begins with its only ``<``, so the first mark of
    the next section's kind is where that section begins, wherever pieces are cut.
    """

    def __init__(self, form: str):
        self.coming = list(ORDER.get(form, ""))
        self.section = "P"  # a plain text is all prefix
        self.kept = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        text = self.kept + piece
        while self.coming and (at := text.find(MARKS[self.coming[0]])) >= 0:
            if at:
                yield self.section, text[:at]
            self.section = self.coming.pop(0)
            text = text[at + len(MARKS[self.section]) :]
        keep = 2 if self.coming else 0  # may be the beginning of a mark
        self.kept = text[len(text) - min(keep, len(text)) :] if keep else ""
        if len(text) > keep:
            yield self.section, text[: len(text) - keep]

    def end(self) -> Iterator[tuple[str, str]]:
        if self.kept:
            yield self.section, self.kept


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_CHARS characters."""

    def batch(some):
        columns = list(zip(*some, strict=True)) if some else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at] or "") + 64
        if chars >= BATCH_CHARS:
            yield batch(held)
            held, chars = [], 0
    yield batch(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _documents(rows: Iterator[tuple]) -> Iterator[Iterator[tuple]]:
    """The rows of one document (equal name and copy) after the other, each as a stream."""
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def one():
            nonlocal row
            while row is not None and row[:2] == key:
                yield row
                row = next(rows, None)

        yield (document := one())
        for _ in document:  # what the reader left
            pass


def _map_rows(df: DataFrame, schema: str, text_at: int, make: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    return df.mapInArrow(lambda batches: _batches(make(_rows(batches)), arrow, text_at), fields)


def fim_pieces(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """The output pieces of every row of (id, text): name, copy, place, the piece, the id,
    and the document's plan on each."""

    def make(rows):
        seen, task = Counter(), TaskContext.get().partitionId()
        for name, doc_id, text in rows:
            # Equal rows have equal pieces, so it doesn't matter which is which on a retry.
            seen[name] += 1
            copy = task << 32 | seen[name]
            text = text or ""
            form, first, second = plan(doc_id, text, seed, plain_percent, spm_percent)
            head = (len(text), form, first, second - first) if form != "plain" else (len(text), form, None, None)
            place = -1
            for place, piece in enumerate(output_pieces(text, form, first, second, chunk)):
                yield name, copy, place, piece, doc_id, *head
            if place < 0:
                yield name, copy, 0, "", doc_id, *head

    named = docs.select(F.xxhash64("id", "text").alias("name"), "id", "text")
    kind = docs.schema["id"].dataType.simpleString()
    return _map_rows(named, f"{KEY}, piece string, id {kind}, {HEAD}", 3, make)


def in_output_order(pieces: DataFrame, tasks: int) -> DataFrame:
    """All pieces of a document in one partition, in the order of the output."""
    return pieces.repartition(tasks, "name", "copy").sortWithinPartitions("name", "copy", "place")


def text_pieces(ordered: DataFrame) -> DataFrame:
    """From pieces in output order the pieces of the texts, by parsing the outputs.

    ``place`` is now the place in the text.  One more row per document, after all others,
    holds the output's SHA-256 and the plan.
    """

    def make(rows):
        for document in _documents(rows):
            digest, restorer, counts, key, head = hashlib.sha256(), None, Counter(), None, None

            def placed(parts):
                for section, text in parts:
                    place = TEXT_ORDER.index(section) << 40 | counts[section]  # noqa: B023
                    counts[section] += 1  # noqa: B023
                    yield *key, place, text, None, None, None, None, None, None  # noqa: B023

            for name, copy, _, piece, *head in document:
                if restorer is None:
                    key, restorer = (name, copy), Restorer(head[2])
                digest.update(piece.encode())
                yield from placed(restorer.feed(piece))
            yield from placed(restorer.end())
            yield *key, len(TEXT_ORDER) << 40, None, *head, digest.hexdigest()

    kind = ordered.schema["id"].dataType.simpleString()
    return _map_rows(ordered, f"{KEY}, piece string, id {kind}, {HEAD}, output_sha256 string", 3, make)


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: the id column, n, form, prefix_chars, middle_chars, and the SHA-256 of the
    output and of the text restored from it."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = in_output_order(fim_pieces(docs, **options), bucket_count(docs, TASK_BYTES))
    # The pieces of a document already lie in one partition: this sort needs no shuffle.
    restored = text_pieces(ordered).sortWithinPartitions("name", "copy", "place")

    def make(rows):
        for document in _documents(rows):
            digest = hashlib.sha256()
            for _, _, _, piece, *rest in document:
                if piece is not None:
                    digest.update(piece.encode())
            yield *rest, digest.hexdigest()

    kind = docs.schema["id"].dataType.simpleString()
    found = _map_rows(restored, f"id {kind}, {HEAD}, output_sha256 string, restored_sha256 string", 5, make)
    return found.withColumnRenamed("id", id_col)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: the id column, n, form, prefix_chars, middle_chars and the ``output`` text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = in_output_order(fim_pieces(docs, **options), bucket_count(docs, TASK_BYTES))

    def make(rows):
        for document in _documents(rows):
            parts = []
            for _, _, _, piece, *head in document:
                parts.append(piece)
            yield *head, "".join(parts)

    kind = docs.schema["id"].dataType.simpleString()
    return _map_rows(ordered, f"id {kind}, {HEAD}, output string", 5, make).withColumnRenamed("id", id_col)


def restored_text(form: str, output: str) -> str:
    """The text that an output was made from."""
    restorer, parts = Restorer(form), {section: [] for section in TEXT_ORDER}
    for section, text in [*restorer.feed(output), *restorer.end()]:
        parts[section].append(text)
    return "".join(text for section in TEXT_ORDER for text in parts[section])


def restore(outputs: DataFrame, id_col: str = "doc_id", output_col: str = "output") -> DataFrame:
    """The id column and ``text`` of rows with ``form`` and an output; null stays null."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            return {id_col: batch.column(0), "text": [None if o is None else restored_text(f, o) for f, o in pairs]}

        return one

    kind = outputs.schema[id_col].dataType.simpleString()
    return map_batches(outputs, [id_col, "form", output_col], f"`{id_col}` {kind}, text string", make)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(read_table(spark, sf_dir, "documents"))
