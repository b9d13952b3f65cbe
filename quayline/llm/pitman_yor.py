"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every token is seated in the restaurant of its context, the word before it or the start of
the text.  Restaurants of words that end alike (last byte and the one before, hashed to
``ENDINGS`` x ``STEMS`` classes) share the restaurant of their class, classes whose last
byte is alike share a parent, and these share the root, whose base is uniform over the
known words and one unknown word.  Tables of a restaurant are customers of the one above.
Gibbs sampling draws the tables of one word in one restaurant from their conditional given
all others: the seatings of its customers enter by their summed weight (a generalised
Stirling number), its tables by what the seating above makes of them.  Predictive
probabilities are averaged over samples of the chain after a burn-in.

At scale: rows of packed numbers travel between buckets of three kinds, one shuffle per
step.  Pairs of word and context lie in buckets by class of the context and by word, so a
hot word is spread by class and all of a word's contexts of one class are together; their
tables are the customers of the word in that class.  Buckets by word hold classes, parents
and root of their words; totals of classes and above are few, and the driver has them.
Buckets by context add up customers and tables of each context's restaurant, however many
there are.  Totals stand still within a round; the seating goes on from round to round.
Texts become blocks of about ``BLOCK_WORDS`` tokens, which bring each bucket each of their
pairs once; what returns is one probability per pair, and the block sums its texts.

A word's name is 54 bits of its hash (see ``hashing``) and 10 of its class, a context's the
lowest 48 of these.

Cases: a null or blank text has its end alone; ids become longs, an id that is no number
an error; other columns are left out, whatever their names; there are no ties, as every
row gets its own score.  Repeated rows count as often as they
stand there.  Without training rows the model is its uniform base and all counts are 0.
Texts are taken whole; a text longer than a block is a block of its own.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.hashing import LETTER, LOWER, U, mix, pieces, range_hashes, text_bytes, word_borders
from quayline.llm.packing import pack, unpack
from quayline.llm.tables import Steps, bucket_count, give_back, read_table

BLOCK_WORDS = 2_000_000
#: Input bytes per bucket of words.
BUCKET_BYTES = 8 << 20
ENDINGS, STEMS = 32, 16
CONTEXTS = ENDINGS * STEMS + 1  # the last one is the start of a text
PARENTS = ENDINGS + 1
PARENT_OF = np.append(np.arange(ENDINGS * STEMS) // STEMS, ENDINGS)
#: Bits of a name that are the word's class, and of a name those that name a context.
CLASS_BITS, CONTEXT_BYTES = 10, 6
END = mix(np.array([0x656E64], U))[0] >> U(CLASS_BITS) << U(CLASS_BITS) | U(CONTEXTS - 1)
#: Discount and strength of class, parent and root restaurants, and of those of words.
DISCOUNT = (0.75, 0.7, 0.6)
STRENGTH = (20.0, 10.0, 5.0)
WORD_DISCOUNT, WORD_STRENGTH = 0.8, 2.0
#: Rounds of totals, Gibbs sweeps in each; sweeps under the last totals before samples, and samples.
ROUNDS, SWEEPS = 3, 1
BURN_IN, SAMPLES = 1, 3
#: Up to so many customers of a word every number of tables is weighed, beyond it so many steps tried.
SINGLY, TRIES = 32, 16
#: The same steps in restaurants of words, and turns in which a word's contexts of one class
#: are redrawn: those of one turn at once, as the class stood before it.
WORD_TRIES, WORD_TURNS = 4, 16
#: Weights of seatings are tabulated up to this many customers.
TABLE = 256


def tokens(data: np.ndarray) -> np.ndarray:
    """Names of the words of a text and of its end; the context of each is the one before
    it, of the first the end."""
    names = []
    for part in pieces(data):
        part = LOWER[part]
        starts, ends = word_borders(part)
        words = range_hashes(LETTER[part], starts, ends)
        last = part[ends - 1].astype(U)
        before = np.where(ends - starts > 1, part[np.maximum(ends - 2, 0)], 0).astype(U)
        ending = mix(last) % U(ENDINGS) * U(STEMS) + mix(before + U(512)) % U(STEMS)
        names.append(words >> U(CLASS_BITS) << U(CLASS_BITS) | ending)
    return np.append(np.concatenate(names), END)


def class_of(names: np.ndarray) -> np.ndarray:
    return (names & U((1 << CLASS_BITS) - 1)).astype(np.int64)


def context_names(names: np.ndarray) -> np.ndarray:
    return names & U((1 << 8 * CONTEXT_BYTES) - 1)


class Shape:
    """How pairs, words and contexts are dealt to buckets: by ``shards`` of classes and
    ``slices`` of words, so that a context meets the buckets of its class only."""

    def __init__(self, buckets: int):
        self.shards = max(1, isqrt(buckets))
        self.slices = -(-buckets // self.shards)
        self.all = self.shards * self.slices

    def shard(self, names: np.ndarray) -> np.ndarray:
        return (mix(class_of(names).astype(U)) % U(self.shards)).astype(np.int64) * self.slices

    def slice(self, names: np.ndarray) -> np.ndarray:
        return ((names >> U(CLASS_BITS)) % U(self.slices)).astype(np.int64)

    def by_context(self, names: np.ndarray) -> np.ndarray:
        """The bucket that adds up a context."""
        return self.all + self.shard(names) + self.slice(names)

    def by_word(self, names: np.ndarray) -> np.ndarray:
        """The bucket of a word's classes."""
        return 2 * self.all + ((names >> U(CLASS_BITS)) % U(self.all)).astype(np.int64)


BLOCK = "block long, ids binary, no_id binary, held binary, sizes binary, words binary, stream binary"


def make_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts (id, text, held_out): their distinct words, and where each token's
    word stands among them."""

    def run(batches):
        number, held, waiting = TaskContext.get().partitionId() << 32, [], 0
        names = [x.split()[0] for x in BLOCK.split(", ")]

        def block():
            known, stream = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            ids = [x[0] for x in held]
            values = {
                "block": number,
                "ids": pack(np.array([i or 0 for i in ids], np.int64)),
                "no_id": pack(np.array([i is None for i in ids], np.uint8)),
                "held": pack(np.array([x[1] for x in held], np.uint8)),
                "sizes": pack(np.array([len(x[2]) for x in held], np.int64)),
                "words": pack(known),
                "stream": pack(stream.astype(np.int32)),
            }
            return pa.RecordBatch.from_arrays(
                [pa.array([values[n]], pa.int64() if n == "block" else pa.binary()) for n in names], names=names
            )

        for batch in batches:
            for i, data, out in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                held.append((i, out, tokens(data)))
                waiting += len(held[-1][2])
                if waiting >= BLOCK_WORDS:
                    yield block()
                    number, held, waiting = number + 1, [], 0
        if held:
            yield block()

    return docs.select("id", "text", "held_out").mapInArrow(run, BLOCK)


def block_pairs(shape: Shape, words: np.ndarray, stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """bucket, word and context (places in ``words``) of a block's distinct pairs, sorted by
    bucket, word and the context's name; and the pair of each token."""
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    before[np.cumsum(sizes) - sizes] = np.searchsorted(words, END)
    order = np.argsort(context_names(words), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    many = len(words)
    bucket = shape.shard(words)[before] + shape.slice(words)[stream]
    pairs, at = np.unique((bucket * many + stream) * many + rank[before], return_inverse=True)
    return pairs // many // many, pairs // many % many, order[pairs % many], at


#: What travels: to a bucket, of a kind, from a bucket or block, up to five packed arrays.
ROW = "to long, kind string, sender long, a binary, b binary, c binary, d binary, e binary"
ROW_NAMES = [x.split()[0] for x in ROW.split(", ")]


def row(to: int, kind: str, sender: int, *packed: bytes) -> tuple:
    return (int(to), kind, int(sender), *packed, *[None] * (5 - len(packed)))


def table_of(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=ROW_NAMES)


def by_kind(table: pa.Table) -> dict[str, list[tuple]]:
    """Per kind its rows (sender, packed arrays), by sender: no result depends on the order
    in which they came."""
    out: dict[str, list[tuple]] = {}
    for _, kind, *rest in sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: (r[1], r[2])):
        out.setdefault(kind, []).append(rest)
    return out


def exchange(rows: DataFrame, step) -> DataFrame:
    """Rows meet in their buckets; ``step`` gets a bucket's name and rows and returns rows."""

    def run(table: pa.Table) -> pa.Table:
        out = table_of(list(step(table["to"][0].as_py(), by_kind(table))))
        give_back()
        return out

    return rows.groupBy("to").applyInArrow(run, ROW)


def dealt(owner: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each owner with the places that it has, in their order."""
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    return [(int(owner[p[0]]), p) for p in np.split(order, cuts[1:])] if len(order) else []


def block_rows(blocks: DataFrame, shape: Shape) -> DataFrame:
    """The pairs of each block, to the buckets of pairs: words, how many pairs of each,
    contexts and training counts of the pairs."""

    def run(batches):
        for batch in batches:
            for block, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, sizes, words, stream = (unpack(p, k) for p, k in zip(packed, (np.uint8, np.int64, U, np.int32), strict=True))
                bucket, word, context, at = block_pairs(shape, words, stream, sizes)
                counts = np.bincount(at[np.repeat(held == 0, sizes)], minlength=len(word)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    known, spans = np.unique(word[a:b], return_counts=True)
                    names = pack(context_names(words[context[a:b]]), CONTEXT_BYTES)
                    made = row(bucket[a], "part", block, pack(words[known]), pack(spans.astype(np.int32)), names, pack(counts[a:b]))
                    yield from table_of([made]).to_batches()
        give_back()

    return blocks.select("block", "held", "sizes", "words", "stream").mapInArrow(run, ROW)


def merged(bucket: int, rows: dict[str, list[tuple]]):
    """The distinct pairs of a bucket from the parts that blocks have sent, and where each
    block's pairs are."""
    parts = rows["part"]
    words, spans, contexts, counts = (
        [unpack(p[1 + k], kind, *width) for p in parts]
        for k, (kind, *width) in enumerate([(U,), (np.int32,), (U, CONTEXT_BYTES), (np.int32,)])
    )
    known, word = np.unique(np.concatenate(words), return_inverse=True)
    names, context = np.unique(np.concatenate(contexts), return_inverse=True)
    keys = np.repeat(word, np.concatenate(spans)) * len(names) + context
    pairs, at = np.unique(keys, return_inverse=True)
    count = np.bincount(at, np.concatenate(counts), len(pairs)).astype(np.int32)
    spans = np.bincount(pairs // len(names), minlength=len(known)).astype(np.int32)
    yield row(
        bucket, "pairs", bucket, pack(known), pack(spans), pack((pairs % len(names)).astype(np.int32)), pack(names, CONTEXT_BYTES), pack(count)
    )
    for part, own in zip(parts, np.split(at, np.cumsum([len(c) for c in contexts])[:-1]), strict=True):
        yield row(bucket, "map", part[0], pack(np.diff(own, prepend=0).astype(np.int32)))


class Bucket:
    """All customers of some words: counts per (word, context) over all blocks."""

    def __init__(self, parts: list[dict]):
        self.blocks = [p["block"] for p in parts]
        words = [unpack(p["words"], U) for p in parts]
        spans = [unpack(p["spans"], np.int32) for p in parts]
        contexts = [unpack(p["contexts"], np.int16).astype(np.int64) for p in parts]
        counts = [unpack(p["counts"], np.int32) for p in parts]
        self.words, word = np.unique(np.concatenate(words), return_inverse=True)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        self.word_of = np.split(word, cuts)  # of each block's words
        keys = np.concatenate([np.repeat(w, s) * CONTEXTS + c for w, s, c in zip(self.word_of, spans, contexts, strict=True)])
        pairs, at = np.unique(keys, return_inverse=True)
        self.pair_of = np.split(at, np.cumsum([len(c) for c in contexts])[:-1])
        self.word, self.context = pairs // CONTEXTS, pairs % CONTEXTS
        self.count = np.bincount(at, np.concatenate(counts), len(pairs)).astype(np.int64)
        above, self.above = np.unique(self.word * PARENTS + PARENT_OF[self.context], return_inverse=True)
        self.above_word, self.parent = above // PARENTS, above % PARENTS
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)


def rise(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log Gamma(a + k) - log Gamma(a) by Stirling's series (error under 1e-6), for a and
    a + k of 5 or more; exact in small k however large a is."""
    end, before, after = a + k, 1 / a, 1 / (a + k)
    series = (after - before) / 12 - (after * after * after - before * before * before) / 360
    return (a - 0.5) * np.log1p(k * before) + k * (np.log(end) - 1) + series


def log_factorial(n: np.ndarray) -> np.ndarray:
    small = np.minimum(n, TABLE)
    return LOG_FACTORIAL[small.astype(np.int64)] + rise(np.full(len(n), TABLE + 1.0), n - small)


def stirling_table(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers of n <= TABLE customers at t tables: the
    weights of all seatings, where a table of m customers weighs (1 - discount) rising m - 1."""
    logs = np.full((TABLE + 1, TABLE + 2), -np.inf)
    logs[0, 0] = 0
    with np.errstate(divide="ignore"):
        for n in range(TABLE):
            stay = logs[n, 1:] + np.log(np.maximum(n - discount * np.arange(1, TABLE + 2), 0))
            logs[n + 1, 1:] = np.logaddexp(logs[n, :-1], stay)
    return logs


LOG_FACTORIAL = np.append(0.0, np.cumsum(np.log(np.arange(1, TABLE + 1))))
STIRLING = {d: stirling_table(d) for d in (*DISCOUNT, WORD_DISCOUNT)}


def log_stirling(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log weight of n customers at t tables: from the table, beyond it a coefficient of
    the generating function (1 - (1 - x) ^ discount) ^ t, integrated over a parabola of
    1 - x around its branch cut that passes the saddle point."""
    cells = np.minimum(n, TABLE).astype(np.int64) * (TABLE + 2) + np.minimum(t, TABLE + 1).astype(np.int64)
    out = STIRLING[discount].take(cells)
    over = np.flatnonzero(n > TABLE)
    if len(over):
        n, t = n[over].astype(float), t[over].astype(float)
        out[over] = np.where(n == t, 0.0, -np.inf)
        inside = (t >= 1) & (t < n)
        big, n, t = over[inside], n[inside], t[inside]
        # The saddle by Newton's method in log(1 - x), from the left of a falling convex function.
        start = np.log(t * discount / n)
        v = start / (1 - discount)
        for _ in range(8):
            one, some = -np.expm1(v), -np.expm1(discount * v)
            slope = (discount - 1) - (1 - one) / one + discount * (1 - some) / some
            v = np.minimum(v - (start + np.log(one) + (discount - 1) * v - np.log(some)) / slope, -1e-12)
        x, saddle = -np.expm1(v), np.exp(v)
        bend = n * np.maximum(1 + x * (1 - discount) / saddle - n / t, 1e-9)
        apex = np.maximum(saddle, 2 / n)
        step = np.where(apex > saddle, 0.4, np.minimum(0.4, 0.35 * x / (apex * np.sqrt(bend))))
        arc = 1 + 1j * step[:, None] * np.arange(13)
        y = apex[:, None] * arc**2
        power = t[:, None] * np.log1p(-(y**discount)) - (n[:, None] + 1) * np.log1p(-y)
        height = np.real(arc * np.exp(power - power[:, :1]))
        area = step * (2 * height.sum(axis=1) - height[:, 0]) * apex / np.pi
        coefficient = np.real(power[:, 0]) + np.log(np.maximum(area, 1e-300))
        out[big] = log_factorial(n) - log_factorial(t) - t * np.log(discount) + coefficient
    return out


def redraw(
    count: np.ndarray, now: np.ndarray, discount: float, others: np.ndarray, above, rng: np.random.Generator, tries: int | None = None
) -> np.ndarray:
    """Tables of ``count`` customers of one word in one restaurant each, drawn from their
    conditional: the weight of the seatings, the restaurant's new tables (``others`` is
    its strength by discount plus its other tables) and ``above(i, k)``, the log
    probability that the parent serves k more.  Up to SINGLY customers every number of
    tables is weighed, beyond that TRIES (or ``tries``) Metropolis steps of all sizes are made."""

    def score(i, k):
        return log_stirling(discount, count[i], k) + rise(others[i], k) + k * np.log(discount) + above(i, k)

    out = now.copy()
    few = np.flatnonzero((count > 1) & (count <= SINGLY))
    if len(few):
        n = count[few].astype(np.int64)
        starts = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(starts, n) + 1.0
        keys = score(np.repeat(few, n), k) - np.log(rng.standard_exponential(len(k)))
        best = np.flatnonzero(keys == np.repeat(np.maximum.reduceat(keys, starts), n))
        where, first = np.unique(np.searchsorted(starts, best, side="right") - 1, return_index=True)
        out[few[where]] = k[best[first]]
    many = np.flatnonzero(count > SINGLY)
    if len(many):
        have = score(many, out[many])
        for _ in range(TRIES if tries is None else tries):
            step = np.ceil(np.exp(rng.random(len(many)) * np.log(count[many] / 2))) * rng.choice([-1.0, 1.0], len(many))
            k = out[many] + step
            good = (k >= 1) & (k <= count[many])
            odds = np.full(len(many), -np.inf)
            odds[good] = score(many[good], k[good])
            taken = np.log(rng.random(len(many))) < odds - have
            out[many[taken]], have[taken] = k[taken], odds[taken]
    return out


def few(n: np.ndarray) -> np.ndarray:
    """Tables to begin with: one, the square root of many customers."""
    return np.where(n <= SINGLY, n > 0, np.sqrt(n).astype(np.int64)).astype(float)


class Pairs:
    """The pairs of a bucket: word, context, training count; ``group`` numbers the pairs of
    one word and class."""

    def __init__(self, packed: tuple):
        self.words, spans = unpack(packed[1], U), unpack(packed[2], np.int32)
        self.word = np.repeat(np.arange(len(self.words)), spans)
        self.context, self.contexts = unpack(packed[3], np.int32), unpack(packed[4], U, CONTEXT_BYTES)
        self.count = unpack(packed[5], np.int32).astype(np.int64)
        groups, self.group = np.unique(self.word * CONTEXTS + class_of(self.contexts)[self.context], return_inverse=True)
        self.group_word, self.group_class = groups // CONTEXTS, groups % CONTEXTS
        # Pairs to redraw by turn: of the pairs of a group that have a choice each in another one.
        some = np.flatnonzero(self.count > 1)
        some = some[np.argsort(self.group[some], kind="stable")]
        first = np.flatnonzero(np.diff(self.group[some], prepend=-1))
        turn = (np.arange(len(some)) - np.repeat(first, np.diff(np.append(first, len(some))))) % WORD_TURNS
        self.turns = [some[turn == k] for k in range(min(WORD_TURNS, int(turn.max(initial=-1)) + 1))]


class Served:
    """log_stirling(discount, n, t) around the n that each group has: beyond the table by a
    parabola through three numbers of customers, 16 apart, as long as n is near them."""

    def __init__(self, discount: float, n: np.ndarray, t: np.ndarray):
        self.discount, self.t = discount, t
        big = np.flatnonzero((n > TABLE - SINGLY) & (n - t >= 64))  # steep where nearly all have tables of their own
        self.base = np.full(len(n), -np.inf)  # never near
        self.base[big] = n[big] - 16
        self.logs = np.zeros((3, len(n)))
        for k in range(3):
            self.logs[k, big] = log_stirling(discount, self.base[big] + 16 * k, t[big])

    def __call__(self, group: np.ndarray, n: np.ndarray, exact: np.ndarray) -> np.ndarray:
        t, base = self.t[group], self.base[group]
        near = (n > TABLE) & ~exact & (np.abs(n - base) <= 64 + np.maximum(base, 0) / 16)
        out = np.empty(len(n))
        out[~near] = log_stirling(self.discount, n[~near], t[~near])
        if near.any():
            x = (n[near] - base[near]) / 16
            one, two, three = self.logs[:, group[near]]
            out[near] = np.where(n[near] < t[near], -np.inf, one + x * (two - one) + x * (x - 1) / 2 * (three - 2 * two + one))
        return out


def word_sweeps(pairs: Pairs, k: np.ndarray, t: np.ndarray, tables: np.ndarray, customers: np.ndarray, sweeps: int, rng: np.random.Generator):
    """Gibbs sweeps over the tables ``k`` of each pair in its word's restaurant, each of
    which is yielded: ``t`` the tables of each group in its class, ``tables`` those of each
    context and ``customers`` of each class, all as they stood.  Pairs of one group are
    redrawn in turns; where those of one turn would together leave the class fewer
    customers than tables, they stay as they were."""
    k, group = k.copy(), pairs.group
    n = np.bincount(group, k, len(t))
    others = WORD_STRENGTH / WORD_DISCOUNT + np.maximum(tables[pairs.context] - k, 0)
    served = STRENGTH[0] + np.maximum(customers[pairs.group_class] - n, 0)
    for _ in range(sweeps):
        weight = Served(DISCOUNT[0], n, t)
        for at in pairs.turns:
            a = group[at]
            rest, many = n[a] - k[at], pairs.count[at] > SINGLY
            drawn = redraw(
                pairs.count[at], k[at], WORD_DISCOUNT, others[at],
                lambda i, x, a=a, rest=rest, many=many: weight(a[i], rest[i] + x, many[i]) - rise(served[a[i]] + rest[i], x), rng, WORD_TRIES,
            )
            new = n + np.bincount(a, drawn - k[at], len(n))
            keep = (new >= t)[a]
            k[at] = np.where(keep, drawn, k[at])
            n = np.where(new >= t, new, n)
        yield k


def at_first(bucket: Bucket) -> tuple:
    """A seating to begin with: (tables of contexts, customers and tables of parents,
    customers and tables of the root)."""
    t = few(bucket.count)
    s = np.bincount(bucket.above, t, len(bucket.parent))
    r = few(s)
    q = np.bincount(bucket.above_word, r, len(bucket.words))
    return t, s, r, q, few(q)


def seatings(bucket: Bucket, history: list[dict], sweeps: int, name: int, start: tuple | None = None):
    """The bucket's chain of seatings, from ``start`` or the first: SWEEPS Gibbs sweeps
    under each of some rounds' totals, then ``sweeps`` under the last, each of which is
    yielded.  A chain is the same whenever it is run again.

    Under one round's totals the other words' tables stand still, the word's own are
    taken out.  Restaurants that share a parent are redrawn one after the other."""
    (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
    t, s, r, q, z = (x.copy() for x in start or at_first(bucket))
    up, word, parent = bucket.above, bucket.above_word, bucket.parent
    siblings = [np.flatnonzero((bucket.context % STEMS == j) & (bucket.count > 0)) for j in range(STEMS)]
    parents = [np.flatnonzero(parent == g) for g in range(PARENTS)]
    for round_, totals in enumerate(history):
        rng = generator(name, round_)
        last = round_ == len(history) - 1
        tables = s0 / d0 + np.maximum(totals["tables"][bucket.context] - t, 0)
        served = s1 + np.maximum(totals["parent_customers"][parent] - s, 0)
        parent_tables = s1 / d1 + np.maximum(totals["parent_tables"][parent] - r, 0)
        root_served = s2 + np.maximum(totals["root_customers"] - q, 0)
        root_tables = s2 / d2 + np.maximum(totals["root_tables"] - z, 0)
        uniform = np.log(1.0 / (totals["vocabulary"] + 1))
        for _ in range(sweeps if last else SWEEPS):
            for at in siblings:
                a = up[at]
                rest = s[a] - t[at]
                drawn = redraw(
                    bucket.count[at], t[at], d0, tables[at],
                    lambda i, k, a=a, rest=rest: log_stirling(d1, rest[i] + k, r[a[i]]) - rise(served[a[i]] + rest[i], k), rng,
                )
                t[at], s[a] = drawn, rest + drawn
            for at in parents:
                w = word[at]
                rest = q[w] - r[at]
                drawn = redraw(
                    s[at], r[at], d1, parent_tables[at],
                    lambda i, k, w=w, rest=rest: log_stirling(d2, rest[i] + k, z[w[i]]) - rise(root_served[w[i]] + rest[i], k), rng,
                )
                r[at], q[w] = drawn, rest + drawn
            z = redraw(q, z, d2, root_tables, lambda i, k: k * uniform, rng)
            if last:
                yield t.copy(), s.copy(), r.copy(), q.copy(), z.copy()


def predictive(bucket: Bucket, totals: dict, state) -> np.ndarray:
    """The probability of each pair of word and context, given one seating."""
    t, s, r, q, z = state
    (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
    root = (q - d2 * z + (s2 + d2 * totals["root_tables"]) / (totals["vocabulary"] + 1)) / (s2 + totals["root_customers"])
    up = bucket.parent
    parent = (s - d1 * r + (s1 + d1 * totals["parent_tables"][up]) * root[bucket.above_word]) / (s1 + totals["parent_customers"][up])
    c = bucket.context
    return (bucket.count - d0 * t + (s0 + d0 * totals["tables"][c]) * parent[bucket.above]) / (s0 + totals["customers"][c])


def generator(bucket: int, round_: int) -> np.random.Generator:
    return np.random.default_rng([20, bucket, round_])


SUMS = {"customers": CONTEXTS, "tables": CONTEXTS, "parent_customers": PARENTS, "parent_tables": PARENTS, "root_customers": 1, "root_tables": 1, "vocabulary": 1, "train": 1}


def pair_step(shape: Shape, totals: dict | None, round_: int):
    """Buckets of pairs: after the first round a sweep under what the other buckets have
    sent; then contexts' sums and groups go out, and the tables to the bucket itself."""

    def step(bucket: int, rows: dict[str, list[tuple]]):
        pairs = Pairs(rows["pairs"][0])
        k = unpack(rows["tables"][0][1], np.int32).astype(float) if totals else few(pairs.count)
        if totals:
            t, tables, _ = received(shape, pairs, rows)
            for k in word_sweeps(pairs, k, t, tables, totals["customers"], SWEEPS, generator(bucket, round_)):
                pass
        yield row(bucket, "tables", bucket, pack(k.astype(np.int32)))
        sums, counts = (np.bincount(pairs.context, v, len(pairs.contexts)).astype(np.int64) for v in (k, pairs.count))
        for owner, at in dealt(shape.by_context(pairs.contexts)):
            yield row(owner, "context", bucket, pack(pairs.contexts[at], CONTEXT_BYTES), pack(sums[at]), pack(counts[at]))
        customers, seen = np.bincount(pairs.group, k, len(pairs.group_word)), np.bincount(pairs.word, pairs.count, len(pairs.words))
        group_owner = shape.by_word(pairs.words)[pairs.group_word]
        groups = dict(dealt(group_owner))
        for owner, at in dealt(shape.by_word(pairs.words)):
            own = groups[owner]
            spans = np.bincount(pairs.group_word[own], minlength=len(pairs.words))[at]
            yield row(
                owner, "group", bucket, pack(pairs.words[at]), pack(spans.astype(np.int32)), pack(pairs.group_class[own].astype(np.int16)),
                pack(customers[own].astype(np.int32)), pack(seen[at].astype(np.int64)),
            )

    return step


def received(shape: Shape, pairs: Pairs, rows: dict[str, list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of each group, tables and customers of each context, from the buckets that
    have them."""
    t = np.zeros(len(pairs.group_word))
    tables, customers = np.zeros(len(pairs.contexts)), np.zeros(len(pairs.contexts))
    from_ = {sender: packed for sender, *packed in rows["sums"]}
    for owner, at in dealt(shape.by_context(pairs.contexts)):
        tables[at], customers[at] = (unpack(from_[owner][x], np.int64) for x in range(2))
    from_ = {sender: packed for sender, *packed in rows["served"]}
    for owner, at in dealt(shape.by_word(pairs.words)[pairs.group_word]):
        t[at] = unpack(from_[owner][0], np.int32)
    return t, tables, customers


def parts_of(rows: dict[str, list[tuple]]) -> list[dict]:
    return [dict(zip(("block", "words", "spans", "contexts", "counts"), r, strict=False)) for r in rows["group"]]


def group_state(b: Bucket, packed: tuple) -> tuple:
    """A seating from the tables that were kept of it."""
    t, r, z = (unpack(x, np.int32).astype(float) for x in packed)
    s = np.bincount(b.above, t, len(b.parent))
    return t, s, r, np.bincount(b.above_word, r, len(b.words)), z


def total_step(shape: Shape, totals: dict | None, round_: int):
    """Buckets of contexts add up their restaurants; those of words seat classes, parents
    and root, send tables back and give their totals."""

    def step(bucket: int, rows: dict[str, list[tuple]]):
        if bucket < 2 * shape.all:
            names = [unpack(r[1], U, CONTEXT_BYTES) for r in rows["context"]]
            _, at = np.unique(np.concatenate(names), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([unpack(r[x], np.int64) for r in rows["context"]])).astype(np.int64) for x in (2, 3)]
            for r, own in zip(rows["context"], np.split(at, np.cumsum([len(x) for x in names])[:-1]), strict=True):
                yield row(r[0], "sums", bucket, *(pack(x[own]) for x in sums))
            return
        b = Bucket(parts_of(rows))
        state = group_state(b, rows["seated"][0][1:4]) if totals else at_first(b)
        if totals:
            for state in seatings(b, [totals], SWEEPS, generator_name(bucket, round_), state):
                pass
        t, s, r, q, z = state
        for sender, pair in zip(b.blocks, b.pair_of, strict=True):
            yield row(sender, "served", bucket, pack(t[pair].astype(np.int32)))
        yield row(bucket, "seated", bucket, *(pack(x.astype(np.int32)) for x in (t, r, z)))
        made = {
            "customers": np.bincount(b.context, b.count, CONTEXTS), "tables": np.bincount(b.context, t, CONTEXTS),
            "parent_customers": np.bincount(b.parent, s, PARENTS), "parent_tables": np.bincount(b.parent, r, PARENTS),
            "root_customers": np.array([q.sum()]), "root_tables": np.array([z.sum()]),
            "vocabulary": np.array([(b.word_count > 0).sum()]),
            "train": np.array([sum(unpack(x[5], np.int64).sum() for x in rows["group"])]),
        }
        yield row(-1, "totals", bucket, pack(np.concatenate([made[x] for x in SUMS]).astype(float)))

    return step


def generator_name(bucket: int, round_: int) -> int:
    return bucket * (ROUNDS + 2) + round_


def sum_totals(rows: DataFrame) -> dict:
    """Sums over all buckets of words.  About 1,100 numbers reach the driver."""

    def run(batches):
        flat = np.zeros(sum(SUMS.values()))  # one set of sums per task, not per bucket
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                flat += unpack(packed, float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "value"])

    sums = rows.where("kind = 'totals'").select("a").mapInArrow(run, "k long, value double")
    flat = np.zeros(sum(SUMS.values()))
    for r in sums.groupBy("k").agg(F.sum("value").alias("value")).collect():
        flat[r.k] = r.value
    cuts = np.cumsum(list(SUMS.values()))[:-1]
    out = dict(zip(SUMS, np.split(flat, cuts), strict=True))
    return {k: float(v[0]) if SUMS[k] == 1 else v for k, v in out.items()}


def class_step(totals: dict):
    """Buckets of words: the averaged probability of each word after each class, and the
    training count of each word, to the buckets of pairs."""

    def step(bucket: int, rows: dict[str, list[tuple]]):
        b = Bucket(parts_of(rows))
        mean = np.zeros(len(b.word))
        name = generator_name(bucket, ROUNDS)
        for x, seated in enumerate(seatings(b, [totals], BURN_IN + SAMPLES, name, group_state(b, rows["seated"][0][1:4]))):
            if x >= BURN_IN:
                mean += predictive(b, totals, seated) / SAMPLES
        seen = np.bincount(np.concatenate(b.word_of), np.concatenate([unpack(x[5], np.int64) for x in rows["group"]]), len(b.words)).astype(np.int64)
        for sender, pair, word in zip(b.blocks, b.pair_of, b.word_of, strict=True):
            yield row(sender, "class", bucket, pack(mean[pair].astype(np.float32)), pack(seen[word]))

    return step


def answer_step(shape: Shape, totals: dict):
    """Buckets of pairs: the averaged log10 probability of each pair of a block and the
    training count of its words, to the blocks."""

    def step(bucket: int, rows: dict[str, list[tuple]]):
        pairs = Pairs(rows["pairs"][0])
        t, tables, customers = received(shape, pairs, rows)
        k, mean = unpack(rows["tables"][0][1], np.int32).astype(float), np.zeros(len(pairs.word))
        for x, seated in enumerate(word_sweeps(pairs, k, t, tables, totals["customers"], BURN_IN + SAMPLES, generator(bucket, ROUNDS))):
            if x >= BURN_IN:
                mean += seated / SAMPLES
        base, seen = np.zeros(len(pairs.group_word)), np.zeros(len(pairs.words), np.int64)
        from_ = {sender: packed for sender, *packed in rows["class"]}
        for owner, at in dealt(shape.by_word(pairs.words)[pairs.group_word]):
            base[at] = unpack(from_[owner][0], np.float32)
        for owner, at in dealt(shape.by_word(pairs.words)):
            seen[at] = unpack(from_[owner][1], np.int64)
        c = pairs.context
        p = word_predictive(pairs.count, mean, tables[c], customers[c], base[pairs.group])
        logs = np.log10(np.maximum(p, 1e-300)).astype(np.float32)
        for block, packed, *_ in rows["map"]:
            at = np.cumsum(unpack(packed, np.int32), dtype=np.int64)
            words = pairs.word[at]
            yield row(block, "answer", bucket, pack(logs[at]), pack(seen[words[np.diff(words, prepend=-1) != 0]]))

    return step


def word_predictive(count, k, tables, customers, base) -> np.ndarray:
    """The probability of a word in the restaurant of the word before it."""
    return (count - WORD_DISCOUNT * k + (WORD_STRENGTH + WORD_DISCOUNT * tables) * base) / (WORD_STRENGTH + customers)


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def block_scores(blocks: DataFrame, found: DataFrame, shape: Shape, totals: dict) -> DataFrame:
    train, vocabulary = totals["train"], totals["vocabulary"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {x.split()[0]: [] for x in SCORES.split(", ")}
        answers = sorted(zip(*(right[x].to_pylist() for x in ("sender", "a", "b")), strict=True))
        for r in left.to_pylist():
            words, stream, sizes = unpack(r["words"], U), unpack(r["stream"], np.int32), unpack(r["sizes"], np.int64)
            bucket, word, _, at = block_pairs(shape, words, stream, sizes)
            # Pairs are sorted by bucket, and each bucket's answer has their order.
            logs = np.concatenate([unpack(a[1], np.float32) for a in answers]).astype(float)
            first = (np.diff(word, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0)
            known = np.zeros(len(words), np.int64)
            known[word[first]] = np.concatenate([unpack(a[2], np.int64) for a in answers])
            starts = np.cumsum(sizes) - sizes
            seen = known[stream]
            base = np.log10((seen + 1) / (train + vocabulary + 1))
            none = unpack(r["no_id"], np.uint8)
            out["id"] += [None if x else i for i, x in zip(unpack(r["ids"], np.int64).tolist(), none.tolist(), strict=True)]
            out["held_out"] += (unpack(r["held"], np.uint8) > 0).tolist()
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += np.add.reduceat(seen > 0, starts, dtype=np.int64).tolist()
            out["train_tokens"] += [int(train)] * len(sizes)
            out["base_score"] += np.add.reduceat(base, starts).tolist()
            out["score"] += np.add.reduceat(logs[at], starts).tolist()
        give_back()
        kinds = {"id": pa.int64(), "held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return blocks.groupBy("block").cogroup(found.groupBy("to")).applyInArrow(score, SCORES)


def language_model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text with a model of those that are not held out.  Per row: the id
    column, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram) and score, both as log10 probabilities of the text.
    Perplexity is 10 ^ (-score / n_tokens)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    shape, steps = Shape(bucket_count(rows, BUCKET_BYTES)), Steps(docs.sparkSession, "lm")
    blocks = steps.write(make_blocks(rows), "blocks")
    merged_rows = steps.write(exchange(block_rows(blocks, shape), merged), "pairs")
    steps.drop()
    pairs, maps = (merged_rows.where(F.col("kind") == kind) for kind in ("pairs", "map"))
    of = lambda rows, *kinds: rows.where(F.col("kind").isin(*kinds))
    totals = sent = back = None
    for n in range(ROUNDS):
        told = pairs if totals is None else pairs.union(of(sent, "tables")).union(of(back, "sums", "served"))
        last, sent = sent, steps.write(exchange(told, pair_step(shape, totals, n)), f"sent-{n}")
        asked = of(sent, "context", "group")
        asked = asked if totals is None else asked.union(of(back, "seated"))
        back = steps.write(exchange(asked, total_step(shape, totals, n)), f"back-{n}")
        totals = sum_totals(back)
        if last is not None:
            steps.drop(f"sent-{n - 1}", f"back-{n - 1}")
    classes = steps.write(exchange(of(sent, "group").union(of(back, "seated")), class_step(totals)), "classes")
    told = pairs.union(maps).union(of(sent, "tables")).union(of(back, "sums", "served")).union(classes)
    answers = exchange(told, answer_step(shape, totals)).select("to", "sender", "a", "b")
    return block_scores(blocks, answers, shape, totals).withColumnRenamed("id", id_col)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return language_model_scores(read_table(spark, sf_dir, "documents"), held_out)
