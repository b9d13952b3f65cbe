"""Benchmark decontamination with one Aho-Corasick automaton.

Every run of ``window`` consecutive words of a test item (its question and answer as
one text; a shorter item is one run) becomes a pattern, with a space on either side.
A document is normalised once, to its words with single spaces between, and scanned
once; word positions lead back to character offsets of the original text.

The items of a benchmark are a stated query set.  They are taken in blocks of at most
``BLOCK_WORDS`` words, so an automaton has a bounded size however many items there are;
a usual benchmark is one block and the documents are then scanned by one automaton.

Cases: null and empty texts have no words and are clean.  Items without words match
nothing; an item with a null id is searched, but can't be named among a document's
items.  Items of equal id count as one.  Each document row is judged by itself, so
repeated rows give repeated results.  Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.tables import map_batches, read_table, written

WINDOW = 10
#: Words of benchmark items in one automaton; 20,000 words make about 100 MB.
BLOCK_WORDS = 20_000
#: The same in letters, for items whose words are very long.
BLOCK_LETTERS = 200_000

# Words are runs of letters and digits of ASCII and of anything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def spaced(words: list[bytes]) -> str:
    """Words with a space around each, one letter per byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def automaton(items: list[tuple[str | None, list[bytes]]], window: int) -> ahocorasick.Automaton | None:
    """One automaton over all runs of ``window`` words of the items."""
    runs: dict[str, tuple[int, set]] = {}
    for name, words in items:
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            runs.setdefault(spaced(words[k : k + size]), (size, set()))[1].add(name)
    if not runs:
        return None
    built = ahocorasick.Automaton()
    for run, (size, names) in runs.items():
        built.add_word(run, (size, tuple(names)))
    built.make_automaton()
    return built


def find(built: ahocorasick.Automaton | None, text: str) -> tuple[list[tuple[int, int]], set]:
    """Word ranges (end exclusive, merged, ascending) hit by any run, and items found."""
    ranges: list[list[int]] = []
    names: set = set()
    if built is None:
        return [], names
    at = word = 0
    # Matches come by their end; a longer run that ends later may begin earlier.
    for end, (size, found) in built.iter(text):
        word += text.count(" ", at, end)
        at = end
        first = word - size
        names.update(found)
        while ranges and ranges[-1][0] >= first:
            ranges.pop()
        if ranges and ranges[-1][1] >= first:
            ranges[-1][1] = word
        else:
            ranges.append([first, word])
    return [(a, b) for a, b in ranges], names


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of bounded size.  The driver holds the query set's words in
    turn; ``toLocalIterator`` brings one partition at a time."""
    out: list[list] = [[]]
    words = letters = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        item = normal_words(row.text)
        size = sum(map(len, item))
        if out[-1] and (words + len(item) > BLOCK_WORDS or letters + size > BLOCK_LETTERS):
            out.append([])
            words = letters = 0
        out[-1].append((row.id, item))
        words, letters = words + len(item), letters + size
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


SPANS = "array<struct<start: int, end: int>>"


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """Per document: the id column, ``n_words``, ``n_hit`` (words inside an occurring
    run), ``items`` (their ids, sorted as strings), ``spans`` (character offsets of hit
    passages in the original text), and the text if ``keep_text``."""
    todo = blocks(benchmark, item_col, item_text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, text_col]
    for k, block in enumerate(todo):
        last = k == len(todo) - 1

        def make(block=block, first=k == 0, last=last):
            built = automaton(block, window)

            def one(batch: pa.RecordBatch) -> dict:
                texts = batch.column(1).to_pylist()
                out = {id_col: batch.column(0), text_col: batch.column(1), "n_words": [], "hits": [], "items": []}
                before = [(None, None)] * len(texts) if first else zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
                for text, (old, old_items) in zip(texts, before, strict=True):
                    words = normal_words(text)
                    ranges, names = find(built, spaced(words))
                    if old:
                        ranges = merge(ranges + [(x["start"], x["end"]) for x in old])
                    names = sorted({*names, *(old_items or [])} - {None})
                    out["n_words"].append(len(words))
                    out["items"].append(names)
                    if last:
                        out.setdefault("n_hit", []).append(sum(b - a for a, b in ranges))
                        out.setdefault("spans", []).append(offsets(text, ranges))
                    else:
                        out["hits"].append([{"start": a, "end": b} for a, b in ranges])
                return out

            return one

        state = f"`{id_col}` {kind}, " + (f"`{text_col}` string, " if keep_text or not last else "")
        state += f"n_words long, n_hit long, items array<string>, spans {SPANS}" if last else f"n_words long, hits {SPANS}, items array<string>"
        docs = map_batches(docs, columns, state, make)
        columns = [id_col, text_col, "n_words", "hits", "items"]
    return docs


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    short_items: bool = True,
) -> DataFrame:
    """The rows of ``docs`` without any passage of the benchmark; columns unchanged.
    Without ``short_items`` only runs of ``window`` words count, so that an item of a
    word or two doesn't drop every document that holds them."""
    for block in blocks(benchmark, item_col, item_text_col):

        def keep(batches, block=block):
            built = automaton([x for x in block if short_items or len(x[1]) >= window], window)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not find(built, spaced(normal_words(t)))[0] for t in texts], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH item_words AS (
    SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark WHERE text IS NOT NULL
), runs AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(words), 10) AS size,
           list_aggregate(words[k : k + least(len(words), 10) - 1], 'string_agg', ' ') AS run
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM item_words WHERE len(words) > 0)
), doc_words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
    FROM documents
), places AS (
    SELECT doc_id, size, k, list_aggregate(words[k : k + size - 1], 'string_agg', ' ') AS run
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k
          FROM doc_words, (SELECT DISTINCT size FROM runs) WHERE len(words) >= size)
), hits AS (
    SELECT doc_id, k, p.size, item FROM places p JOIN runs r ON p.run = r.run AND p.size = r.size
), counts AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS w FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN counts USING (doc_id) LEFT JOIN named USING (doc_id)
"""
