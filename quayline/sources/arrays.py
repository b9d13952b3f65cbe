"""Arrays of documents in files that no task should hold, element by element.

A line begins outside of any string, as strings of JSON hold no line ends.  So the
brackets that a split of a file opens and closes can be counted by itself, a running sum
over the splits of a file (one row each) gives the depth at which every split begins, and
each split is then cut at the commas of the outermost array in one pass.  Elements
that lie in one split are whole; pieces at the borders of splits meet once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.documents import parsed_document

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
MARK = re.compile(STRING + r"|[\[\]{},]")
BLANK = "\ufeff \t\r\n"
#: Kinds of pieces: an element, its end, its beginning, neither, and what is no array.
WHOLE, END, BEGIN, INSIDE, BROKEN = range(5)
#: Letters of elements that a task passes on together.
HELD = 1 << 22
PIECES = "key string, split long, kind int, text string"


class Cutter:
    """The pieces of one split, line by line, each with the bracket or comma on either
    side of it."""

    def __init__(self, depth: int, seen: bool, left_open: bool):
        self.depth, self.seen, self.broken = depth, seen, left_open
        self.begun, self.parts = False, []

    def line(self, text: str) -> Iterator[tuple[int, str]]:
        at = 0
        for mark in MARK.finditer(text):
            sign, k = text[mark.start()], mark.start()
            if sign in "[{":
                if self.depth == 0:
                    before = "".join(self.parts) + text[at:k]
                    self.broken |= sign == "{" or self.seen or before.strip(BLANK) != ""
                    self.parts, self.begun, self.seen, at = [], True, True, k
                self.depth += 1
            elif sign in "]}":
                self.broken |= self.depth < 1 or (self.depth == 1 and sign == "}")
                self.depth -= 1
                if self.depth == 0:
                    yield self._cut(text[at : k + 1])
                    self.begun, at = False, k + 1
            elif sign == "," and self.depth == 1:
                yield self._cut(text[at : k + 1])
                self.begun, at = True, k
        self.parts.append(text[at:])

    def _cut(self, last: str) -> tuple[int, str]:
        text = "\n".join([*self.parts, last])
        self.parts = []
        return WHOLE if self.begun else END, text

    def rest(self) -> Iterator[tuple[int, str]]:
        text = "\n".join(self.parts)
        if self.depth > 0:
            yield BEGIN if self.begun else INSIDE, text
        elif text.strip(BLANK):
            self.broken = True
        if self.broken:
            yield BROKEN, ""


def _pieces(kinds: set[int]):
    """Task over rows of (key, split, at, line, depth, seen, total), sorted, the first of a
    split being where it begins."""

    def run(batches):
        here, cutter, rows, letters = None, None, [], 0

        def taken(found):
            nonlocal letters
            for kind, text in found:
                if kind in kinds:
                    rows.append((*here, kind, text))
                    letters += len(text)

        def batch_of():
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            types = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "split", "kind", "text"])

        for batch in batches:
            for key, split, line, depth, seen, total in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                if here != (key, split):
                    if cutter:
                        taken(cutter.rest())
                    here, cutter = (key, split), Cutter(depth, seen, total != 0 or depth < 0)
                    continue
                taken(cutter.line(line))
                if letters > HELD:
                    yield batch_of()
                    rows, letters = [], 0
        if cutter:
            taken(cutter.rest())
        yield batch_of()

    return run


def array_elements(lines: DataFrame) -> DataFrame:
    """``key, split, line`` of files that hold one array each -> ``key, doc``, its
    elements.  A file that holds something else stops the query.

    Only pieces at the borders of splits (two of each at most) are put together over
    tasks; an element is held by one task.
    """
    lines = lines.select("key", "split", F.monotonically_increasing_id().alias("at"), "line")
    bare = F.regexp_replace("line", STRING, "")
    change = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    splits = lines.groupBy("key", "split").agg(F.sum(change).alias("change"))
    before = Window.partitionBy("key").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "key", "split", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("line"),
        F.coalesce(F.sum("change").over(before), F.lit(0).cast("long")).alias("depth"),
        (F.count("*").over(before) > 0).alias("seen"),
        F.sum("change").over(Window.partitionBy("key")).alias("total"),
    )
    met = lines.unionByName(starts, allowMissingColumns=True).repartition("key", "split").sortWithinPartitions("key", "split", "at")

    whole = met.mapInArrow(_pieces({WHOLE, BROKEN}), PIECES)
    # Within a split the end of an element comes before the beginning of the next.
    borders = met.mapInArrow(_pieces({END, BEGIN, INSIDE}), PIECES)
    so_far = Window.partitionBy("key").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = borders.withColumn("element", F.sum((F.col("kind") == BEGIN).cast("int")).over(so_far))
    joined = numbered.groupBy("key", "element").agg(F.sort_array(F.collect_list(F.struct("split", "kind", "text"))).alias("parts"))
    put = joined.select("key", F.lit(WHOLE).alias("kind"), F.concat_ws("\n", "parts.text").alias("text"))

    found = whole.select("key", "kind", "text").unionByName(put).where(~F.rlike("text", F.lit(r"^\[[ \t\r\n]*\]$")))
    stop = F.raise_error(F.concat(F.lit("not JSON Lines nor one array, pass layout='whole': "), F.col("key"))).cast("string").cast("variant")
    inner = F.btrim(F.substring("text", F.lit(2), F.length("text") - 2), F.lit(BLANK))
    doc = F.when(F.col("kind") == WHOLE, F.coalesce(parsed_document(inner), stop)).otherwise(stop)
    return found.select("key", doc.alias("doc"))
