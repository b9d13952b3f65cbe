"""Links between classes of equal sets, and the components that they make.

Classes that meet somewhere (in a band of sketch coordinates, under a signature) are
candidates.  Of the classes of a place the least is its centre.  Every class is first
compared with the least of its centres, then with its other centres if these lie in unlike
components, then in a few of its places with the nearest class of another component, which
joins what has no common centre, at last with every class that is still of unlike
component in one of its places.  In the last two steps the centre of a place, which has met
all others there, is left out, and of places with the same classes one stays.  A pair is
dropped if the caller's test or sizes and parts of the sets rule it out, and decided on
the whole sets otherwise, so no link that matters for components is lost.  Large sets,
which so few parts can't tell apart, have parts in proportion to their size as well, which
meet for the pairs that are left before any text moves.

Texts of a hub and its spokes meet as sorted streams, a hub's spokes dealt over many
tasks; a task holds one hub's set at a time.  Only texts that may be wanted are shuffled: a
bitmap of fixed size says of most others that they are not.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.hashing import U, mix, shingle_hashes, text_bytes, word_hashes
from quayline.llm.tables import Steps, give_back, map_batches

#: Spokes that meet one copy of their hub, and members of a place that lie in one block.
SPOKES = 64
BLOCK = 1024
#: Turns in which every class is compared with its nearest one in so many bands.
TURNS = 2
FEW = 4
#: Parts of the feature domain by which sets are told apart.
PARTS = 512
#: Pairs that a task remembers, so that it gives a pair of many common bands once.
REMEMBERED = 1 << 18
#: Bits of the bitmap that texts are looked up in before they are shuffled: half a megabyte.
BITS = 1 << 22


def document_set(data: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    return np.unique(shingle_hashes(word_hashes(data), size))


def set_class(elements: np.ndarray) -> int:
    """One number per set, as a signed 64-bit integer."""
    return int(mix(np.array([mix(elements).sum(dtype=U) + U(len(elements))], U)).view(np.int64)[0])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """BITS bits, one of them set for each value of the only column, 64-bit hashes; what
    reaches the driver has one size, however many values there are."""
    place = F.col(hashes.columns[0]).bitwiseAND(BITS - 1) + 1
    groups = hashes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("k"))
    out = np.zeros((-(-BITS // 32768), 4096), np.uint8)
    for r in groups.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        out[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of ``bits``; True for all that are."""
    place = hashes & (BITS - 1)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0


def among(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows whose first column, a hash, may be among those of ``bits``."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def first_texts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """name, text of every unlike text of a task whose name may be among those of
    ``bits``, once, however often it is repeated."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            names = batch.column(0)
            wanted = in_bitmap(bits, names.to_numpy()).tolist()
            new = [w and not (n in seen or seen.add(n)) for n, w in zip(names.to_pylist(), wanted, strict=True)]
            yield batch.filter(pa.array(new, pa.bool_()))

    return docs.select(F.xxhash64("text").alias("name"), "text").mapInArrow(run, "name long, text string")


def set_parts(elements: np.ndarray) -> bytes:
    """One byte for each of PARTS parts of the feature domain, from the elements there:
    every element that only one of two sets has changes one of them at most.  The lowest
    bit is the parity of their number, so a part that differs in others only hides two."""
    place = mix(elements + U(0x2545F4914F6CDD1D))
    part = (place % U(PARTS)).astype(np.int64)
    sums = np.zeros(PARTS, U)
    np.add.at(sums, part, place >> U(16))
    odd = np.bincount(part, minlength=PARTS).astype(U) & U(1)
    return (mix(sums) << U(1) & U(0xFE) | odd).astype(np.uint8).tobytes()


def parts_apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many elements at least only one of two sets has, by the parts in their rows:
    one for each part of unlike parity, two for each other part that differs."""
    unlike = one ^ two
    return np.where(unlike & 1, 1, np.where(unlike, 2, 0)).sum(axis=1)


def fine_parts(elements: np.ndarray) -> np.ndarray:
    """One byte for each of as many parts as half the set's elements or more, a power of
    two: the exclusive or of odd numbers, so the lowest bit is the parity again, and parts
    of a larger power become those of a smaller one by ``folded``."""
    parts = max(PARTS, 1 << (len(elements) - 1).bit_length() - 1)
    place = mix(elements + U(0x6A09E667F3BCC909))
    out = np.zeros(parts, np.uint8)
    np.bitwise_xor.at(out, (place & U(parts - 1)).astype(np.int64), (place >> U(48) | U(1)).astype(np.uint8))
    return out


def folded(parts: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(parts.reshape(-1, size), axis=0)


def set_marks(parts: np.ndarray) -> np.ndarray:
    """Two bits of each part of each row, its parity and another, as 64-bit numbers: no
    more of them differ between two sets than parts do, and a part that differs by one
    element always does."""
    two = (parts & 3).reshape(len(parts), PARTS // 4, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(two, axis=2).astype(np.uint8).view("<u8")


def marks_differ(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many marks each row of ``one`` differs from ``two``."""
    unlike = one ^ two
    return np.bitwise_count((unlike | unlike >> U(1)) & U(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def marks_apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """As ``parts_apart``, by the marks of each row of ``one`` and those of ``two``."""
    unlike = one ^ two
    even = unlike >> U(1) & ~unlike & U(0x5555555555555555)
    return marks_differ(one, two) + np.bitwise_count(even).sum(axis=1, dtype=np.int64)


def with_marks(texts: DataFrame) -> DataFrame:
    """class, n, marks: a quarter of the parts' bytes, for rows that are copied to many places."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            parts = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, PARTS)
            return {"class": batch.column(0), "n": batch.column(1), "marks": [m.tobytes() for m in set_marks(parts)]}

        return one

    return map_batches(texts, ["class", "n", "parts"], "class long, n int, marks binary", make)


def with_parts(texts: DataFrame, size: int) -> DataFrame:
    """class, n, parts, text: the set's size and its parts beside the text."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            sets = [document_set(data, size) for data in text_bytes(batch.column(1))]
            return {"class": batch.column(0), "n": [len(s) for s in sets], "parts": [set_parts(s) for s in sets], "text": batch.column(1)}

        return one

    return map_batches(texts, ["class", "text"], "class long, n int, parts binary, text string", make)


def possible(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that sizes and parts let be similar."""
    left = texts.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    right = texts.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
                most = (100 - percent) * (na + nb) // (100 + percent)
                yield batch.select([0, 1]).filter(pa.array((parts_apart(one, two) <= most) & (np.abs(na - nb) <= most)))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
    return joined.mapInArrow(run, "a long, b long")


def classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class"))


def finely_possible(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that sizes and, for sets of more than 2 * PARTS
    elements, parts in proportion to them let be similar."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            classes, counts, fine = [], [], []
            for name, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                elements = document_set(data, size) if n > 2 * PARTS else None
                if elements is not None and set_class(elements) != name:
                    continue  # another text of the same name
                classes.append(name)
                counts.append(n)
                fine.append(None if elements is None else fine_parts(elements).tobytes())
            return {"class": classes, "n": counts, "fine": fine}

        return one

    wanted = among(texts.select("class", "n", "text"), bitmap(classes_of(pairs)))
    fine = map_batches(wanted, ["class", "n", "text"], "class long, n int, fine binary", make)
    left, right = (fine.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, *both in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                most = (100 - percent) * (na + nb) // (100 + percent)
                fits = abs(na - nb) <= most
                if fits and None not in both:
                    one, two = (np.frombuffer(x, np.uint8) for x in both)
                    parts = min(len(one), len(two))
                    fits = parts_apart(folded(one, parts)[None], folded(two, parts)[None])[0] <= most
                keep.append(bool(fits))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, texts: DataFrame, size: int, percent: int, tasks: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose whole sets are similar.

    The text of ``a`` travels to ``b``, the hub.  A hub's spokes are dealt over places of
    about SPOKES each, and each place gets the hub's text before those of its spokes.
    """
    places = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPOKES).cast("long").alias("places"))
    spokes = pairs.join(places, "b").select("b", F.pmod(F.xxhash64("a"), "places").alias("place"), F.lit(1).alias("side"), F.col("a").alias("class"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1))
    hubs = places.select("b", each.alias("place"), F.lit(0).alias("side"), F.col("b").alias("class"))
    wanted = among(texts.select("class", "text"), bitmap(classes_of(pairs)))

    def run(batches):
        hub, held = None, None
        for batch in batches:
            keys, places, sides, classes = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for k, data in enumerate(text_bytes(batch.column(4))):
                elements = document_set(data, size)
                if set_class(elements) != classes[k]:
                    continue  # another text of the same name
                if sides[k] == 0:
                    hub, held = (keys[k], places[k]), elements
                elif hub == (keys[k], places[k]):
                    both = len(np.intersect1d(held, elements, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(elements) - both):
                        found.append((classes[k], keys[k]))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    texted = spokes.unionByName(hubs).join(wanted, "class").select("b", "place", "side", "class", "text")
    met = texted.repartition(tasks, "b", "place").sortWithinPartitions("b", "place", "side")
    return met.mapInArrow(run, "a long, b long")


def few_bands(members: DataFrame, turn: int) -> DataFrame:
    """Of each class its rows of FEW bands, the first ones in an order that all share."""
    first = Window.partitionBy("class").orderBy(F.xxhash64("band", F.lit(turn)))
    return members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FEW).drop("n")


def unlike_pairs(
    members: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, tasks: int, nearest: bool = False
) -> DataFrame:
    """Pairs (a, b) of classes of one band but of unlike labels, as far as sizes and
    parts let them be similar; this loses no similar pair.

    Within a band the label with most members is left out of one side: only the other
    members are copied to all blocks of the band, so a band that is nearly one component
    costs what it has members.  Blocks are streams in which the copied members come first.
    Pairs whose sizes and marks can't be similar never leave a block, and a task gives a
    pair of many bands once as long as it remembers it; each pair meets the whole parts
    afterwards.  With ``nearest`` a member gives only the pair whose marks differ least.
    """
    named = members.select("band", "class").join(labels, "class", "left").select("band", "class", F.coalesce("label", "class").alias("label"))
    per_label = named.groupBy("band", "label").agg(F.count("*").alias("n"))
    split = per_label.groupBy("band").agg(
        F.sum("n").alias("size"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most")
    )
    split = split.where("labels > 1").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.col("most.label").alias("most"))
    rest = named.join(split, "band").join(with_marks(texts), "class")
    columns = ["class", "label", "n", "marks"]
    own = rest.select("band", F.pmod("class", "blocks").cast("int").alias("block"), F.lit(1).alias("side"), *columns)
    copied = rest.where(F.col("label") != F.col("most")).select(
        "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), *columns
    )

    def run(batches):
        here, held, table, sent = None, [], None, set()
        for batch in batches:
            if len(sent) > REMEMBERED:
                sent.clear()
            bands, blocks, sides, classes, labels_, sizes, marks = (batch.column(k).to_pylist() for k in range(7))
            left, right = [], []
            for k, side in enumerate(sides):
                if here != (bands[k], blocks[k]):
                    here, held, table = (bands[k], blocks[k]), [], None
                if side == 0:
                    held.append((classes[k], labels_[k], sizes[k], marks[k]))
                    continue
                if not held:
                    continue
                if table is None:
                    names, kinds, counts = (np.array([h[c] for h in held]) for c in range(3))
                    table = np.frombuffer(b"".join([h[3] for h in held]), "<u8").reshape(len(held), -1)
                most = (100 - percent) * (counts + sizes[k]) // (100 + percent)
                some = np.flatnonzero((kinds != labels_[k]) & (np.abs(counts - sizes[k]) <= most))
                differ = marks_apart(table[some], np.frombuffer(marks[k], "<u8"))
                fits = np.flatnonzero(differ <= most[some])
                if nearest and len(fits):
                    fits = fits[[np.argmin(differ[fits])]]
                for x in names[some[fits]].tolist():
                    pair = (x, classes[k]) if x < classes[k] else (classes[k], x)
                    if pair not in sent:
                        sent.add(pair)
                        left.append(pair[0])
                        right.append(pair[1])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        give_back()

    met = own.unionByName(copied).repartition(tasks, "band", "block").sortWithinPartitions("band", "block", "side")
    pairs = met.mapInArrow(run, "a long, b long").distinct()
    return pairs if nearest else possible(pairs, texts, percent)


def of_unlike_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    one = labels.select(F.col("class").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("class").alias("b"), F.col("label").alias("lb"))
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """class, label of all classes in links (a, b): the least class of each component.

    Every round takes the least label around each class and then the label of that
    label, until nothing changes; each round is written, so lineage stays short, and
    deleted when the next one is there.
    """
    steps = Steps(links.sparkSession, "components")
    both = steps.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = steps.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "class"), "0")
    for turn in count(1):
        around = both.join(labels, both.b == labels["class"]).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(around, labels["class"] == around.a, "left").select(
            "class", "label", F.least("label", "near").alias("near")
        )
        jump = labels.select(F.col("class").alias("near"), F.col("label").alias("far"))
        new = near.join(jump, "near", "left").select("class", "label", F.least("near", "far").alias("new"))
        new = steps.write(new, str(turn))
        steps.drop(str(turn - 1))
        if new.where("new <> label").limit(1).count() == 0:
            steps.drop("links")
            return new.select("class", "label")
        labels = new.select("class", F.col("new").alias("label"))


def with_low(met: DataFrame) -> DataFrame:
    """band, class, low: of rows (band, class) those whose band has another class too,
    beside the least class there."""
    shared = met.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    return met.join(shared.select("band", "low"), "band").select("band", "class", "low")


def places_beside_centres(members: DataFrame) -> DataFrame:
    """band, class: what is left to compare of rows (band, class, low) when every class
    has met its centres.  Each band's other classes once, if there are two or more; of
    bands with the same other classes one stays."""
    rest = members.where("class <> low").select("band", "class").distinct()
    name = F.xxhash64("class")
    kinds = rest.groupBy("band").agg(
        F.count("*").alias("n"), F.min("class").alias("least"),
        F.sum(name.bitwiseAND(0xFFFFFFFF)).alias("low_sum"), F.sum(F.shiftrightunsigned(name, 32)).alias("high_sum"),
    )
    one = kinds.where("n > 1").groupBy("n", "least", "low_sum", "high_sum").agg(F.min("band").alias("band"))
    return rest.join(one.select("band"), "band", "left_semi")


def representatives(docs: DataFrame, names: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class, n, parts, text of the wanted classes, from rows with a text; ``names`` are
    (class, name): the hash of one text of each class.  A text that many tasks have read
    stands once; texts of one name are told apart by another hash."""
    named = names.join(wanted, "class", "left_semi")
    texts = first_texts(docs, bitmap(named.select("name"))).join(named, "name").withColumn("other", F.hash("text"))
    return with_parts(texts.dropDuplicates(["name", "class", "other"]), size)


def linked_components(
    steps: Steps, members: DataFrame, stars: DataFrame, texts: DataFrame, likely: Callable[[DataFrame], DataFrame], size: int, percent: int, tasks: int
) -> DataFrame:
    """class, label of all classes that are linked with another one.

    ``members`` are (band, class, low), ``stars`` their distinct pairs (a, b) of a class
    and a centre; ``likely`` drops pairs of these that can't be similar.
    """

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        close = steps.write(finely_possible(pairs, texts, size, percent), f"{name}-close")
        links = steps.write(similar(close, texts, size, percent, tasks), name)
        steps.drop(f"{name}-close")
        return links

    first = steps.write(likely(stars.groupBy("a").agg(F.min("b").alias("b"))), "first")
    links = verify(first, "links-1")
    labels = components(links)
    second = steps.write(likely(of_unlike_labels(stars, labels)), "second")
    links = links.union(verify(second, "links-2"))
    labels = components(links)
    places = steps.write(places_beside_centres(members), "places")
    for turn in range(TURNS):
        near = unlike_pairs(few_bands(places, turn), labels, texts, percent, tasks, nearest=True)
        links = links.union(verify(steps.write(near, f"near-{turn}"), f"links-near-{turn}"))
        labels = components(links)
    tried = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a centre is less than its members
    third = steps.write(unlike_pairs(places, labels, texts, percent, tasks).join(tried, ["a", "b"], "left_anti"), "third")
    steps.drop("first", "second")
    more = verify(third, "links-3")
    if more.limit(1).count():
        labels = components(links.union(more))
    steps.drop("third", "places")
    return labels
