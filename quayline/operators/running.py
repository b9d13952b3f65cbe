"""Running sums, trailing-window counts and as-of lookups that never hold one key in one task.

A plain window function sorts all rows of a key in one task.  One key may hold a
third of all rows, so keys that hold more than a fair share are cut along the
order axis, at its quantiles: a slice of such a key holds about 1/slices of all
rows at most.  Each slice is summed by itself, and the totals of the earlier
slices (one row per hot key and slice) are added afterwards.  All other keys stay
whole and cost what a plain window costs.  "The last value so far" is cut the same way,
with the last value of each slice in place of its total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
QUANTILE_ACCURACY = 10_000
# What Spark's sketch of frequent items can be asked for.
SKETCH_ITEMS = 100_000
TRACKED_KEYS = 10_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hot_keys_and_bounds(
    df: DataFrame, keys: Sequence[str], order: str, slices: int | None = None
) -> tuple[list[int], list[float]]:
    """Hashes of the keys with more than 1/slices of the rows, and the quantiles of
    the order column: at most ``slices`` numbers each, all that reaches the driver.

    One pass of sketches over the keys and the order.  An estimate that is off
    changes how evenly rows spread, never a result.
    """
    slices = slices or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), SKETCH_ITEMS)
    if slices == 1:
        return [], []
    shares = [i / slices for i in range(1, slices)]
    tracked = F.lit(max(TRACKED_KEYS, 8 * slices))
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.call_function("approx_top_k", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"), F.lit(slices), tracked).alias("top"),
        F.percentile_approx(order, shares, max(QUANTILE_ACCURACY, 4 * slices)).alias("quantiles"),
    ).first()
    hot = [t["item"] for t in found["top"] or [] if t["count"] * slices > found["rows"]]
    return hot, sorted({float(v) for v in found["quantiles"] or []})


def is_hot(keys: Sequence[str], hot: Sequence[int]) -> Column:
    return F.xxhash64(*keys).isin(list(hot)) if keys else F.lit(True)


def with_slice(df: DataFrame, keys: Sequence[str], order: str, hot: Sequence[int], bounds: Sequence[float]) -> DataFrame:
    """Add ``_slice``: for a hot key the slice ``order`` falls in (-1 for NULL), for
    any other 0; equal values of a key always share a slice."""
    if not hot or not bounds:
        return df.withColumn("_slice", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_slice_at", outputCol="_slice_cut")
    # Bucketizer takes doubles; order values up to 2^53 stay exact.
    sliced = cut.transform(df.withColumn("_slice_at", F.col(order).cast("double")))
    number = F.coalesce(F.col("_slice_cut").cast("int"), F.lit(-1))
    number = F.when(is_hot(keys, hot), number).otherwise(0)
    return sliced.withColumn("_slice", number).drop("_slice_at", "_slice_cut")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    ties: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` per key along the numeric column ``order``.

    With ``ties`` each row gets its own sum (rows of equal order are taken in the
    order of ``ties``); without, rows of equal order all get the sum after them.
    Rows whose order is NULL come first.  Finding hot keys takes a pass over the
    keys and ``order``, their totals take another, so store ``df`` first if it is
    costly to compute.
    """
    return running_sums(df, keys, order, {out: value}, ties, slices)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], ties: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Several running sums (output column -> summed column) along one order, in one pass."""
    hot, bounds = hot_keys_and_bounds(df, keys, order, slices)
    return _sliced_sums(df, keys, order, sums, ties, hot, bounds, df)


def _sliced_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    ties: Sequence[str],
    hot: Sequence[int],
    bounds: Sequence[float],
    movements: DataFrame,
) -> DataFrame:
    """The running sums for given hot keys and bounds; ``movements`` are rows with
    the same sums per key and order, from which the totals are taken."""
    group = [*keys, "_slice"]
    within = Window.partitionBy(*group).orderBy(order, *ties)
    frame = within.rowsBetween if ties else within.rangeBetween
    local = {out: F.sum(value).over(frame(Window.unboundedPreceding, Window.currentRow)) for out, value in sums.items()}
    summed = with_slice(df, keys, order, hot, bounds).withColumns(local)
    if not hot or not bounds:
        return summed.drop("_slice")

    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    of_hot = with_slice(movements.where(is_hot(keys, hot)), keys, order, hot, bounds)
    totals = of_hot.groupBy(*group).agg(*[F.sum(value).alias(f"_total_{k}") for k, value in enumerate(sums.values())])
    offsets = totals.select(*group, *[F.sum(f"_total_{k}").over(before).alias(f"_offset_{k}") for k in range(len(sums))])
    joined = summed.alias("s").join(offsets.alias("o"), _same_group(keys), "left")
    kept = [F.col(f"s.`{c}`") for c in df.columns if c not in sums]
    added = [(F.col(f"s.`{out}`") + F.coalesce(f"o._offset_{k}", F.lit(0))).alias(out) for k, out in enumerate(sums)]
    return joined.select(*kept, *added)


def _same_group(keys: Sequence[str]) -> list[Column]:
    return [*[F.col(f"s.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in keys], F.col("s._slice") == F.col("o._slice")]


def last_so_far(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, ties: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the key at or before each row, along the
    numeric column ``order``; rows of equal order are taken in the order of ``ties``.

    This is an as-of lookup without a join: put what is looked up (with a ``value``) and
    what asks (without) into one DataFrame.  A hot key is cut into slices of the order;
    a slice starts from the last value of the slices before it, one row per hot key and
    slice, and nothing is ever paired.
    """
    hot, bounds = hot_keys_and_bounds(df, keys, order, slices)
    group = [*keys, "_slice"]
    within = Window.partitionBy(*group).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = with_slice(df, keys, order, hot, bounds).withColumn(out, F.last(value, ignorenulls=True).over(within))
    if not hot or not bounds:
        return found.drop("_slice")
    of_hot = with_slice(df.where(is_hot(keys, hot) & F.col(value).isNotNull()), keys, order, hot, bounds)
    last = of_hot.groupBy(*group).agg(F.max_by(value, F.struct(order, *ties)).alias("_end"))
    # Every slice of a hot key gets a row, with values or not: what came before it.
    numbers = F.transform(F.sequence(F.lit(-1), F.lit(len(bounds))), lambda n: F.struct(n.alias("_slice"), F.lit(None).cast(df.schema[value].dataType).alias("_end")))
    all_slices = last.select(*keys).distinct().select(*keys, F.inline(numbers))
    filled = last.select(*group, "_end").unionByName(all_slices).groupBy(*group).agg(F.max_by("_end", F.col("_end").isNotNull()).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = filled.select(*group, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    joined = found.alias("s").join(carried.alias("o"), _same_group(keys), "left")
    kept = [F.col(f"s.`{c}`") for c in df.columns if c != out]
    return joined.select(*kept, F.coalesce(F.col(f"s.`{out}`"), F.col("o._carried")).alias(out))


def running_total(
    deliveries: DataFrame, table: str = "table", arrival: str = "arrival", rows: str = "ingested", tie: str = "request_id"
) -> DataFrame:
    """Rows in the table after each delivery, in order of arrival (``total``).

    ``arrival`` is numeric (epoch milliseconds); ``tie`` orders equal arrivals.
    """
    return running_sum(deliveries, [table], arrival, rows, "total", ties=[tie])


def window_counts(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, slices: int | None = None
) -> DataFrame:
    """Requests of a key in the trailing ``seconds`` up to each of its instants.

    Both ends of the window count.  Returns ``*keys, ts, requests``, one row per
    key and instant.  For most keys this is a plain range window.  The rows of a
    hot key are first counted per instant; each count then enters a running sum at
    its instant and leaves it right after the window has passed.
    """
    at = micros(ts)

    def moves(rows: DataFrame, n: Column) -> DataFrame:
        # What enters at t counts for t itself, what leaves at t goes after it:
        # steps 2t and 2t+1.
        enter = F.struct((2 * at).alias("step"), n.alias("change"), F.lit(True).alias("enters"))
        leave = F.struct((2 * (at + seconds * MICROS) + 1).alias("step"), (-n).alias("change"), F.lit(False).alias("enters"))
        return rows.select(*keys, ts, F.inline(F.array(enter, leave)))

    timed = df.where(F.col(ts).isNotNull())
    hot, bounds = hot_keys_and_bounds(moves(timed, F.lit(1).cast("bigint")), keys, "step", slices)
    trailing = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-seconds * MICROS, Window.currentRow)
    others = timed.where(~is_hot(keys, hot)) if hot else timed
    counts = others.select(*keys, ts, at.alias("_at")).withColumn("requests", F.count("*").over(trailing))
    counts = counts.drop("_at").distinct()  # grouped by key already: no further shuffle
    if not hot:
        return counts
    busy = timed.where(is_hot(keys, hot))
    counted = busy.groupBy(*keys, ts).agg(F.count("*").alias("_n"))
    movements = moves(busy, F.lit(1).cast("bigint"))
    summed = _sliced_sums(moves(counted, F.col("_n")), keys, "step", {"requests": "change"}, (), hot, bounds, movements)
    return counts.unionByName(summed.where("enters").select(*keys, ts, "requests"))


def rate_exceeded(
    df: DataFrame, keys: Sequence[str], ts: str, limit: int, seconds: int, out: str = "exceeded"
) -> DataFrame:
    """Add whether a row is beyond ``limit`` requests of its key in the trailing
    window.  Only the instants over the limit are joined back, usually few."""
    over = window_counts(df, keys, ts, seconds).where(F.col("requests") > limit).select(*keys, ts)
    over = over.withColumn(out, F.lit(True)).alias("o")
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in (*keys, ts)]
    joined = df.alias("r").join(over, same, "left")
    return joined.select("r.*", F.coalesce(F.col(f"o.`{out}`"), F.lit(False)).alias(out))
