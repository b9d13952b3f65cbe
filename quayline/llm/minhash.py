"""Near-duplicates of documents by fast similarity sketches, banding and exact verification.

A document is the set of its word n-grams.  Its sketch has ``t`` coordinates, filled in
rounds of hashed bin placement: round i throws every element into one of the t bins with
the value i plus a fraction, and a bin keeps the least value it ever got.  A bin that is
filled in a round can't get less in a later one, so rounds end when no bin is empty: a
set of many elements needs one or two, a set of n elements about t * ln(t) / n.  After t
rounds, round t + b puts every element into bin b, so no bin of any set stays empty.
Two sets agree in a coordinate with the chance of their Jaccard similarity, and the number
of agreeing coordinates is concentrated about that share as that of independent ones.

1. Texts with equal sets are one class; only classes are compared, and only those of
   sets so large that an unequal one can be similar.
2. Bands: ``rows`` coordinates are one key; there are so many bands that a pair at the
   threshold shares none with a chance of ``miss`` (1e-9) only.
3. Classes that share a band are compared (see ``linking``): with centres first, a pair
   being dropped if its sketches agree in fewer coordinates than a similar pair's do (but
   for a chance of ``miss``), then what lies in unlike components, a pair being dropped
   only if it is proved unlike.  Every other pair is decided on the whole sets.

Steps are written to the shared folder and deleted as soon as nothing reads them any more.

Cases: null, empty and blank texts have empty sets, are linked with nothing and keep
themselves; a text of fewer words than an n-gram is one n-gram.  Repeated rows fall into
one class and each gets its row, with the same answer (so each is ``kept`` if its id is
the least).  Ids may have any type that has an order; null ids never become a component's
id unless all its ids are null, and then the row is kept.  Other columns of the input,
whatever their names, are neither read nor returned.  Texts are taken whole.  An empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.hashing import U, mix, text_bytes
from quayline.llm.linking import document_set, linked_components, representatives, set_class, with_low
from quayline.llm.tables import Steps, bucket_count, map_batches, read_table

#: Coordinates in a band, and the chance with which a similar pair may be missed.
ROWS = 5
MISS = 1e-9
#: Input bytes per task where texts meet.
MEET_BYTES = 32 << 20

EMPTY = U(0xFFFFFFFFFFFFFFFF)
FRACTION = U(0xFFFFFFFF)


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair of this similarity shares one but for a chance of ``miss``."""
    if not 50 < percent < 100:
        raise ValueError("a similarity between 50 and 100 percent is needed")
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def least_agreement(t: int, percent: int, miss: float = MISS) -> int:
    """The least number of t coordinates in which a pair of this similarity agrees but
    for a chance of ``miss``."""
    g, below = percent / 100, 0.0
    for k in range(t + 1):
        below += math.exp(math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1) + k * math.log(g) + (t - k) * math.log(1 - g))
        if below > miss:
            return k
    return t


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set of distinct 64-bit hashes; each is round << 32 plus a
    fraction of 32 bits."""
    out = np.full(t, EMPTY, U)
    done, at_once = 0, max(1, 3 * t // len(elements))
    while done < t:
        rounds = np.arange(done, min(t, done + at_once), dtype=U)
        thrown = mix(elements[None, :] + mix(rounds)[:, None])
        bins = ((thrown >> U(32)) * U(t) >> U(32)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((rounds << U(32))[:, None] | thrown & FRACTION).ravel())
        done += len(rounds)
        if (out != EMPTY).all():
            return out
    for b in np.flatnonzero(out == EMPTY).tolist():
        last = np.array([t + b], U)
        out[b] = (last << U(32) | (mix(elements + mix(last)) & FRACTION).min())[0]
    return out


def short_sketch(elements: np.ndarray, t: int) -> bytes:
    """The sketch with 16 bits a coordinate: unequal ones agree once in 65,536 times."""
    return (mix(sketch(elements, t)) & U(0xFFFF)).astype("<u2").tobytes()


def sketched(docs: DataFrame, size: int, percent: int, t: int) -> DataFrame:
    """id, name, n_shingles, class and sketch of every row of (id, text).

    ``name`` is a hash of the text, ``class`` one of the set (null if it is empty).  The
    sketch stands with the first row of its class in a task, and is null for sets that
    are similar to equal sets only.
    """

    def make():
        seen: set[int] = set()

        def one(batch: pa.RecordBatch) -> dict:
            counts, classes, sketches = [], [], []
            for data in text_bytes(batch.column(2)):
                elements = document_set(data, size)
                counts.append(len(elements))
                classes.append(name := set_class(elements) if len(elements) else None)
                # A set of n elements is at best n / (n + 1) similar to an unequal one.
                new = name is not None and name not in seen and 100 * len(elements) >= percent * (len(elements) + 1)
                sketches.append(short_sketch(elements, t) if new else None)
                if new:
                    seen.add(name)
            return {"id": batch.column(0), "name": batch.column(1), "n_shingles": counts, "class": classes, "sketch": sketches}

        return one

    named = docs.select("id", F.xxhash64("text").alias("name"), "text")
    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(named, ["id", "name", "text"], f"id {kind}, name long, n_shingles long, class long, sketch binary", make)


def band_members(sketches: DataFrame, bands: int, rows: int) -> DataFrame:
    """band, class, low: every class under every band that it shares with another one,
    beside the least class of the band."""
    width = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * width + 1, F.lit(width))))
    return with_low(sketches.select("class", F.explode(keys).alias("band")))


def likely(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sketches agree in ``least`` coordinates."""
    left = sketches.select(F.col("class").alias("a"), F.col("sketch").alias("left"))
    right = sketches.select(F.col("class").alias("b"), F.col("sketch").alias("right"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((one == two).sum(axis=1) >= least))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """Per row: the id column, ``n_shingles``, ``class``, ``component_id`` (the least id
    that links reach) and ``kept`` (whether the row's id is that one)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bands = band_count(percent, rows, miss)
    least = least_agreement(bands * rows, percent, miss)
    tasks = bucket_count(docs, MEET_BYTES)
    steps = Steps(docs.sparkSession, "minhash")

    all_rows = steps.write(sketched(docs, size, percent, bands * rows), "rows")
    signed = all_rows.where("sketch is not null")
    members = steps.write(band_members(signed, bands, rows), "members")
    stars = steps.write(members.where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("class")).union(stars.select("b")).distinct()
    sketches = steps.write(signed.select("class", "sketch").join(wanted, "class", "left_semi").dropDuplicates(["class"]), "sketches")
    # One text stands for each class that is compared; texts travel once to meet its name.
    per_class = all_rows.where("class is not null").groupBy("class").agg(F.min("name").alias("name"), F.min("id").alias("least"))
    per_class = steps.write(per_class, "classes")
    texts = steps.write(representatives(docs, per_class.select("class", "name"), wanted, size), "texts")
    labels = linked_components(steps, members, stars, texts, lambda pairs: likely(pairs, sketches, least), size, percent, tasks)
    steps.drop("members", "stars", "sketches", "texts")

    named = per_class.join(labels, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    found = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    found = found.select(F.col("class").alias("of"), F.col("component_id").alias("reached"))
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("reached"))
    return all_rows.join(found, F.col("class") == F.col("of"), "left").select(
        F.col("id").alias(id_col), "n_shingles", "class", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class")
