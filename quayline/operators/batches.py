"""Delivery batches of a buffer that is emptied when it is full or old enough."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.operators.running import MICROS, last_so_far, micros, running_sums
from quayline.session import stored

#: The time of records without one: before all others.
NO_TIME = -(1 << 52)


def next_batch(nodes: DataFrame, max_bytes: int, seconds: int, slices: int | None = None) -> DataFrame:
    """_stream, _pos, _next: for every record the first record of the batch after the one
    that this record would begin (no row if none is known to come).

    ``nodes`` are (_stream, _pos, _at, _size, _held): ``_held`` bytes up to and with the
    record.  A batch is full with the first record whose running sum reaches ``max_bytes``
    more than what was held before its own first, and too old from the first record on
    that comes ``seconds`` after that one.  Both are searched for all records at once, as
    the last value so far along the sums, and the times, in descending order.
    """
    width = seconds * MICROS

    def lane(number, order, wanted, value):
        looked_up = [F.lit(number), -order, F.lit(0), -F.col("_pos"), value]
        asks = [F.lit(number), -wanted, F.lit(1), F.lit(0).cast("long"), F.lit(None).cast("long")]
        names = ["_lane", "_order", "_kind", "_tie", "_value"]
        return [F.struct(*[c.alias(n) for c, n in zip(some, names, strict=True)]) for some in (looked_up, asks)]

    full = lane(0, F.col("_held"), F.col("_held") - F.col("_size") + max_bytes, F.col("_pos") + 1)
    old = lane(1, F.col("_at"), F.col("_at") + width, F.col("_pos"))
    lanes = nodes.select("_stream", "_pos", F.inline(F.array(*full, *old)))
    found = last_so_far(lanes, ["_stream", "_lane"], "_order", "_value", "_next", ["_kind", "_tie"], slices)
    return found.where("_kind = 1").groupBy("_stream", "_pos").agg(F.min("_next").alias("_next")).where("_next is not null")


def _follow(rows: DataFrame, jump: DataFrame, at: str) -> DataFrame:
    """Where ``jump`` leads from the positions in column ``at``: _stream, _pos, _next."""
    same = F.col("r._stream").eqNullSafe(F.col("j._stream")) & (F.col(f"r.{at}") == F.col("j._pos"))
    return rows.alias("r").join(jump.alias("j"), same).select("r._stream", "r._pos", "j._next")


def batch_starts(jump: DataFrame, firsts: DataFrame) -> DataFrame:
    """_stream, _pos of every record that begins a batch: what the pointers in ``jump``
    reach from the first record of each stream.

    By pointer doubling: the pointers over 1, 2, 4, ... batches are made by joins of a
    table with itself, and each of them is applied once to all starts so far.  For b
    batches these are 2 * log2(b) joins, and no task walks along a stream.
    """
    levels = [stored(jump, "jump")]
    while not levels[-1].isEmpty():
        levels.append(stored(_follow(levels[-1], levels[-1], "_next"), "jump"))
    starts = firsts
    for level in reversed(levels[:-1]):
        reached = _follow(starts, level, "_pos").select("_stream", F.col("_next").alias("_pos"))
        starts = stored(starts.unionByName(reached), "starts")
    return starts


def assign_batches(
    df: DataFrame,
    stream: str,
    ts: str,
    size: str,
    max_bytes: int,
    seconds: int,
    ties: Sequence[str],
    slices: int | None = None,
) -> DataFrame:
    """Add the delivery batch of each record: ``batch`` (from 0 per stream) and ``opened``,
    the time of its first record.

    A batch begins with a stream's first record.  It ends with the record that fills it
    to ``max_bytes``, or before the first record that comes ``seconds`` or more after it
    was opened; then bytes and timer begin anew.  Records are taken in the order of
    ``ts`` and ``ties``; those without a time come first and are batched by bytes alone,
    a NULL or negative size counts as 0.
    """
    own = {
        "_stream": F.col(stream),
        "_at": F.coalesce(micros(ts), F.lit(NO_TIME)),
        "_size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)),
        "_one": F.lit(1).cast("long"),
    }
    numbered = running_sums(df.withColumns(own), ["_stream"], "_at", {"_held": "_size", "_pos": "_one"}, ties, slices)
    numbered = stored(numbered, "numbered")
    nodes = numbered.select("_stream", "_pos", "_at", "_size", "_held")
    starts = batch_starts(next_batch(nodes, max_bytes, seconds, slices), nodes.where("_pos = 1").select("_stream", "_pos"))

    same = F.col("n._stream").eqNullSafe(F.col("s._stream")) & (F.col("n._pos") == F.col("s._pos"))
    opened = nodes.alias("n").join(starts.alias("s"), same).select("n._stream", "n._pos", "n._at", F.lit(1).cast("long").alias("_one"))
    opened = running_sums(opened, ["_stream"], "_pos", {"_batch": "_one"}, ["_at"], slices)
    begun = F.struct((F.col("_batch") - 1).alias("batch"), F.col("_at").alias("at"))
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = numbered.select("_stream", "_pos", F.lit(1).alias("_kind"), record.alias("_record"))
    parts = [opened.select("_stream", "_pos", F.lit(0).alias("_kind"), begun.alias("_begun")), rows]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = last_so_far(both, ["_stream"], "_pos", "_begun", "_in", ["_kind"], slices).where("_kind = 1")
    at = F.when(F.col("_in.at") != NO_TIME, F.timestamp_micros(F.col("_in.at")).cast("timestamp_ntz"))
    return found.select("_record.*", F.col("_in.batch").alias("batch"), at.alias("opened"))
