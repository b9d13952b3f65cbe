"""Similarity join of documents by the Jaccard similarity of their word n-grams,
with PartEnum signatures, and the groups that its links make.

Two sets of similarity g or more differ in at most k = (1-g)/(1+g) * (|a|+|b|) elements.
Sizes are cut into bands; a set is signed for its own band and, if it is large enough
to match larger sets, for the next.  Within a band the feature domain is split by a
hash into n1 parts of n2 sub-parts.  Two similar sets have at most k2 differences in at
least one part, so they agree on some n2 - k2 of its sub-parts: the hash of a set's
elements in each such choice of sub-parts is one signature.  Sets that share no
signature are not similar; those that do are candidates, and every candidate is
verified on the whole sets.

Texts with equal sets are one class, and only classes are compared; which of those that
share a signature are compared, and how, says ``linking``: no link that matters for
components is lost.

Hashes of words, n-grams and sets have 64 bits (see ``hashing``).

Cases: null, empty and blank texts have empty sets and are linked with nothing; a text
of fewer words than an n-gram is one n-gram.  Repeated rows, and ties, fall into one class
and each gets its row.  Ids may have any type that has an order; null ids never become a
component's id unless all ids are null.  Texts are taken whole.  Other columns, whatever
their names, are not read by ``similarity_groups`` and all kept by ``keep_one``.  Empty
input gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quayline.llm.hashing import U, mix, text_bytes
from quayline.llm.linking import document_set, linked_components, possible, representatives, set_class, with_low
from quayline.llm.packing import pack, unpack
from quayline.llm.tables import Steps, bucket_count, give_back, map_batches, read_table

#: Each band's sizes reach from this share of its largest size, or from the similarity.
BAND = 0.75
#: Input bytes per bucket of signatures, and per task where texts meet; signatures per
#: block on the way to the buckets.
BUCKET_BYTES = 24 << 20
MEET_BYTES = 32 << 20
BLOCK = 1 << 19
#: Share of sets that may have to keep empty signatures, and how far spare parts are tried.
RISK = 1e-4
MOST_SPARE = 16


def more_than(most: int, mean: float) -> float:
    """The chance that a Poisson count exceeds ``most``."""
    if mean > 600:
        return 1.0
    term = total = math.exp(-mean)
    for k in range(1, most + 1):
        term *= mean / k
        total += term
    return max(0.0, 1.0 - total)


class Signer:
    """PartEnum for sets whose similarity is at least ``percent`` / 100."""

    def __init__(self, percent: int):
        if not 50 < percent < 100:
            raise ValueError("a similarity between 50 and 100 percent is needed")
        self.percent = percent
        self.band = min(BAND, percent / 100)  # so that similar sets lie in one band or in two that touch

    def differences(self, sizes: int) -> int:
        """Most differing elements of two similar sets of so many elements together."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019
    def _edges(self, band: int) -> tuple[int, int]:
        """Sizes of a band: above the first, up to the second."""
        if band == 0:
            return 0, 1
        low = self._edges(band - 1)[1]
        return low, math.floor(low / self.band) + 1

    def bands(self, size: int) -> list[int]:
        """The bands that a set of this size is signed for."""
        band = 0
        while self._edges(band)[1] < size:
            band += 1
        next_least = self._edges(band)[1] + 1
        return [band, band + 1] if 100 * size >= self.percent * next_least else [band]

    @lru_cache(maxsize=None)  # noqa: B019
    def shape(self, band: int) -> tuple[int, int, int, int]:
        """n1, n2, k2 and ``spare`` of one band: the fewest signatures that will do.

        ``spare`` parts are added beyond those that the pigeonhole principle needs, so
        that at least ``spare`` + 1 parts agree.  A set with at most ``spare`` parts
        that have an empty signature can then leave its empty signatures away, which
        would meet those of all other such sets.
        """
        low, high = self._edges(band)
        k = self.differences(2 * high)
        if k == 0:
            return 0, 0, 0, 0  # only equal sets are similar, and these are one class
        least = -(-self.percent * (low + 1) // 100)
        best = None
        for k2 in range(min(k, 4) + 1):
            for n2 in range(k2 + 1, k2 + 5) if k2 else (1,):
                choices = math.comb(n2, k2)
                for spare in range(MOST_SPARE + k // 4):
                    n1 = k // (k2 + 1) + 1 + spare
                    empty = min(1.0, choices * (1 - (n2 - k2) / (n1 * n2)) ** least)
                    risk = more_than(spare, n1 * empty)
                    cost = (True, risk) if risk > RISK else (False, n1 * choices)
                    if best is None or cost < best[0]:
                        best = cost, (n1, n2, k2, spare)
                    if risk <= RISK:
                        break
        return best[1]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """All signatures of a set, given as distinct 64-bit hashes."""
        out = [self._sign(elements, band) for band in self.bands(len(elements))] if len(elements) else []
        return np.concatenate(out) if out else np.zeros(0, U)

    def _sign(self, elements: np.ndarray, band: int) -> np.ndarray:
        n1, n2, k2, spare = self.shape(band)
        if not n1:
            return np.zeros(0, U)
        place = mix(elements + U(0x5851F42D4C957F2D))
        cell = ((place >> U(32)) % U(n1) * U(n2) + (place & U(0xFFFFFFFF)) % U(n2)).astype(np.int64)
        sums = np.zeros(len(elements) + 1, U)
        np.cumsum(place[np.argsort(cell, kind="stable")], out=sums[1:])
        counts = np.bincount(cell, minlength=n1 * n2)
        ends = np.cumsum(counts)
        sums = (sums[ends] - sums[ends - counts]).reshape(n1, n2)
        counts = counts.reshape(n1, n2)
        made, empty = [], []
        for k, chosen in enumerate(combinations(range(n2), n2 - k2)):
            chosen = list(chosen)
            name = mix(np.arange(n1, dtype=U) * U(64) + U(k) + U(band << 40))
            held = counts[:, chosen].sum(axis=1)
            made.append(mix(sums[:, chosen].sum(axis=1, dtype=U) + name + held.astype(U)))
            empty.append(held == 0)
        made, empty = np.concatenate(made), np.array(empty)
        if empty.any() and empty.any(axis=0).sum() <= spare:
            made = made[~empty.reshape(-1)]
        return made


def document_classes(docs: DataFrame, size: int) -> DataFrame:
    """id, name (a hash of the text), n_shingles, class (null for empty sets) of every row
    of (id, text)."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            counts, classes = [], []
            for data in text_bytes(batch.column(2)):
                elements = document_set(data, size)
                counts.append(len(elements))
                classes.append(set_class(elements) if len(elements) else None)
            return {"id": batch.column(0), "name": batch.column(1), "n_shingles": counts, "class": classes}

        return one

    named = docs.select("id", F.xxhash64("text").alias("name"), "text")
    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(named, ["id", "name", "text"], f"id {kind}, name long, n_shingles long, class long", make)


def shared_signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """sig, class: every class under every signature that it shares with another class.

    Signatures travel as packed blocks, sorted into buckets by a hash: 48 bits of each
    signature beside its bucket, and its class by place in the block's list.  Within
    a block each pair of signature and class stands once, and of a signature's classes
    only the least goes to the signature's bucket; the others, whose signature is shared
    already, are spread by class.  So a hot signature brings its bucket one pair per
    block, not one per document.
    """
    buckets = bucket_count(docs, BUCKET_BYTES)

    def blocks(batches):
        signer = Signer(percent)
        held: list[tuple[np.ndarray, int]] = []

        def flush():
            sigs = np.concatenate([s for s, _ in held])
            classes = np.repeat(np.array([c for _, c in held], np.int64), [len(s) for s, _ in held])
            held.clear()
            sigs = (sigs // U(buckets) & U((1 << 48) - 1)) * U(buckets) + sigs % U(buckets)
            order = np.lexsort((classes, sigs))
            sigs, classes = sigs[order], classes[order]
            first = np.ones(len(sigs), bool)
            first[1:] = sigs[1:] != sigs[:-1]
            again = ~first
            again[1:] &= classes[1:] != classes[:-1]  # equal pairs stand once
            shared = np.zeros(len(sigs), bool)
            shared[np.flatnonzero(first)] = np.add.reduceat(again, np.flatnonzero(first)) > 0
            for kind, mask, key in (("one", first, sigs), ("more", again, mix(classes.view(U)))):
                where = (key[mask] % U(buckets)).astype(np.int64)
                by = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.diff(where[by], prepend=-1))
                s, c, x = sigs[mask][by], classes[mask][by], shared[mask][by]
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=False):
                    some, place = np.unique(c[a:b], return_inverse=True)
                    short = pack(s[a:b] // U(buckets), 6) if kind == "one" else pack(s[a:b])
                    yield int(where[by[a]]), kind, short, pack(some), pack(place.astype(np.int32)), pack(x[a:b].view(np.uint8))

        def out(rows):
            rows = list(rows)
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(arrays, names=["bucket", "kind", "sigs", "classes", "places", "shared"])

        types = [pa.int64(), pa.string(), *[pa.binary()] * 4]
        waiting = 0
        for batch in batches:
            for data in text_bytes(batch.column(1)):
                elements = document_set(data, size)
                sigs = signer.signatures(elements)
                if len(sigs):
                    held.append((sigs, set_class(elements)))
                    waiting += len(sigs)
                if waiting >= BLOCK:
                    yield out(flush())
                    waiting = 0
                    give_back()
        if held:
            yield out(flush())
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        parts = {"one": ([], [], []), "more": ([], [], [])}
        names = ("bucket", "kind", "sigs", "classes", "places", "shared")
        for bucket, kind, sigs, classes, places, shared in zip(*(table[n].to_pylist() for n in names), strict=True):
            short = unpack(sigs, U, 6) * U(buckets) + U(bucket) if kind == "one" else unpack(sigs, U)
            for into, values in zip(parts[kind], (short, unpack(classes, np.int64)[unpack(places, np.int32)], unpack(shared, bool)), strict=True):
                into.append(values)
        join = lambda arrays, kind: np.concatenate([*arrays, np.zeros(0, kind)])
        sigs, classes, shared = (join(p, t) for p, t in zip(parts["one"], (U, np.int64, bool), strict=True))
        order = np.lexsort((classes, sigs))
        sigs, classes, shared = sigs[order], classes[order], shared[order]
        new = np.ones(len(sigs), bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (classes[1:] != classes[:-1])
        starts = np.flatnonzero(np.r_[len(sigs) > 0, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, int)
        if len(starts):
            whole = np.add.reduceat(new.astype(int), starts) + np.add.reduceat(shared.astype(int), starts)
            keep = new & np.repeat(whole > 1, np.diff(np.r_[starts, len(sigs)]))
            sigs, classes = sigs[keep], classes[keep]
        more_sigs, more_classes = (join(p, t) for p, t in zip(parts["more"][:2], (U, np.int64), strict=True))
        give_back()
        return pa.table({
            "sig": np.concatenate([sigs, more_sigs]).view(np.int64), "class": np.concatenate([classes, more_classes])
        })

    sent = docs.select("id", "text").mapInArrow(
        blocks, "bucket long, kind string, sigs binary, classes binary, places binary, shared binary"
    )
    return sent.groupBy("bucket").applyInArrow(meet, "sig long, class long")


def similarity_groups(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id column, ``n_shingles``, ``class``, ``group`` (one number per
    component; null for empty sets) and ``component_id``, the least id that links of at
    least ``percent`` similarity reach."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    steps, tasks = Steps(docs.sparkSession, "jaccard"), bucket_count(rows, MEET_BYTES)
    classes = steps.write(document_classes(rows, size), "classes")
    per_class = classes.where("class is not null").groupBy("class").agg(F.min("name").alias("name"), F.min("id").alias("least"))
    per_class = steps.write(per_class, "per-class")
    met = steps.write(shared_signatures(rows, size, percent).withColumnRenamed("sig", "band"), "signatures")
    members = steps.write(with_low(met), "members")
    steps.drop("signatures")
    stars = steps.write(members.where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("class")).union(stars.select("b")).distinct()
    texts = steps.write(representatives(rows, per_class.select("class", "name"), wanted, size), "texts")
    labels = linked_components(steps, members, stars, texts, lambda pairs: possible(pairs, texts, percent), size, percent, tasks)
    steps.drop("members", "stars", "texts")

    named = per_class.join(labels, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    found = named.withColumnRenamed("class", "of").join(
        named.groupBy("label").agg(F.min("least").alias("component_id")), "label"
    )
    return classes.join(found, classes["class"] == found["of"], "left").select(
        F.col("id").alias(id_col), "n_shingles", "class", F.col("label").alias("group"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def free_name(base: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case of letters."""
    while base.lower() in {c.lower() for c in columns}:
        base += "_"
    return base


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component,
    that of the least id (of rows with equal id and set, any one); texts without words
    all stay."""
    groups = similarity_groups(docs, size, percent, id_col, text_col).where("class is not null")
    best = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "class")).alias("kept")
    chosen = groups.groupBy("group").agg(best)
    name = free_name("class", docs.columns)

    def tag(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            sets = (document_set(data, size) for data in text_bytes(texts))
            classes = pa.array([set_class(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, classes], names=[*batch.schema.names, name])

    tagged = docs.mapInArrow(tag, StructType([*docs.schema.fields, StructField(name, LongType())]))
    key, kept_key, kept_id, kept_class = (free_name(n, tagged.columns) for n in ("key", "kept_key", "kept_id", "kept_class"))
    chosen = chosen.select(
        F.xxhash64("kept.id", "kept.class").alias(kept_key), F.col("kept.id").alias(kept_id), F.col("kept.class").alias(kept_class)
    )
    own_id, own_class = F.col(f"`{id_col}`"), F.col(f"`{name}`")
    worded = tagged.where(own_class.isNotNull()).withColumn(key, F.xxhash64(own_id, own_class))
    # The hash alone is the join's key, the rest a condition that is no equality, so that
    # rows of one id and class lie together after the join without another shuffle of texts.
    same_id = F.coalesce(own_id == F.col(kept_id), own_id.isNull() & F.col(kept_id).isNull())
    same = (F.col(key) == F.col(kept_key)) & same_id & F.coalesce(own_class == F.col(kept_class), F.lit(False))
    kept = worded.join(chosen, same, "left_semi").dropDuplicates([key, id_col, name]).drop(key)
    return kept.unionByName(tagged.where(own_class.isNull())).drop(name)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_groups(read_table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "class")
