import numpy as np
import pytest

from quayline.llm import linking as m
from quayline.llm.hashing import U, mix
from tests.llm.test_jaccard import corpus, shingles, similar


def table(spark, sets):
    parts = [m.set_parts(np.array([hash(x) & (1 << 62) - 1 for x in s]).astype(U)) for s in sets]
    rows = [(k, len(s), bytearray(p)) for k, (s, p) in enumerate(zip(sets, parts, strict=True))]
    return spark.createDataFrame(rows, "class long, n int, parts binary")


def test_unlike_pairs_are_all_that_can_be_similar(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 4)
    docs = corpus(9, 25, 80)
    sets = [shingles(t, 3) for _, t in docs]
    members = spark.createDataFrame([(k % 3, k) for k in range(len(sets))], "band long, class long")
    labels = spark.createDataFrame([(k, k // 2 % 4) for k in range(len(sets)) if k % 5], "class long, label long")
    held = table(spark, sets)
    label = lambda k: k // 2 % 4 if k % 5 else k
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if a % 3 == b % 3 and label(a) != label(b)]
    rows = m.unlike_pairs(members, labels, held, 80, 4).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(rows) == len(got) and got <= set(pairs) and len(got) < len(pairs) / 2
    linked = {(a, b) for a, b in pairs if similar(sets[a], sets[b], 80)}
    assert linked and linked <= got


def test_places_keep_every_pair_beside_centres(spark):
    rng = np.random.default_rng(4)
    bands = {k: set(rng.choice(40, int(rng.integers(2, 6)), replace=False).tolist()) for k in range(300)}
    bands |= {300 + k: bands[k % 20] for k in range(200)}
    rows = [(k, c, min(v)) for k, v in bands.items() for c in sorted(v)] + [(0, c, min(bands[0])) for c in bands[0]] * 3
    got = m.places_beside_centres(spark.createDataFrame(rows, "band long, class long, low long")).collect()
    places = {}
    for r in got:
        places.setdefault(r.band, set()).add(r["class"])
    assert len(got) == sum(len(v) for v in places.values())  # repeated rows stand once
    want = {frozenset(v - {min(v)}) for v in bands.values() if len(v) > 2}
    assert len(places) == len(want) and {frozenset(v) for v in places.values()} == want


def test_a_pair_of_many_bands_leaves_a_task_once(spark, monkeypatch):
    sets = [shingles(t, 3) for _, t in corpus(9, 25, 80)]
    members = spark.createDataFrame([(band, k) for band in range(30) for k in range(len(sets))], "band long, class long")
    labels = spark.createDataFrame([], "class long, label long")
    whole = {(r.a, r.b) for r in m.unlike_pairs(members, labels, table(spark, sets), 80, 1).collect()}
    monkeypatch.setattr(type(members), "distinct", lambda self: self)
    rows = m.unlike_pairs(members, labels, table(spark, sets), 80, 1).collect()
    assert whole and len(rows) == len(whole)


def test_a_text_of_many_tasks_stands_once(spark):
    docs = spark.createDataFrame([(k, "a b c d" if k % 2 else f"e f {k}") for k in range(64)], "id long, text string").repartition(8)
    names = docs.select(m.F.pmod("id", m.F.lit(2)).alias("class"), m.F.xxhash64("text").alias("name")).where("class = 1 or id = 0").distinct()
    texts = m.representatives(docs.select("id", "text"), names, names.select("class"), 3).collect()
    assert sorted((r["class"], r.n, r.text) for r in texts) == [(0, 1, "e f 0"), (1, 2, "a b c d")]


def test_possible_pairs_lose_no_similar_pair(spark):
    sets = [shingles(t, 3) for _, t in corpus(3, 20, 80)]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    got = {(r.a, r.b) for r in m.possible(spark.createDataFrame(pairs, "a long, b long"), table(spark, sets), 80).collect()}
    linked = {(a, b) for a, b in pairs if similar(sets[a], sets[b], 80)}
    assert linked and linked <= got and len(got) < 2 * len(linked) + 20


@pytest.mark.parametrize("percent", [60, 90])
def test_parts_differ_in_no_more_than_elements(percent):
    rng = np.random.default_rng(percent)
    for n in (3, 50, 2000):
        some = mix(rng.integers(0, 1 << 62, n).astype(U))
        other = some[: max(1, n * percent // 100)]
        one, two = (np.frombuffer(m.set_parts(s), np.uint8) for s in (some, other))
        assert (one != two).sum() <= n - len(other) and (one == np.frombuffer(m.set_parts(some[::-1]), np.uint8)).all()


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 102), (102, 101)] + [(200, k) for k in range(201, 230)]
    got = {r["class"]: r.label for r in m.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in (100, 101, 102)} | {k: 200 for k in range(200, 230)}


@pytest.mark.parametrize("percent", [60, 90])
def test_marks_differ_in_no_more_than_parts(percent):
    rng = np.random.default_rng(percent)
    for n in (3, 50, 2000):
        sets = [mix(rng.integers(0, 1 << 62, n).astype(U)) for _ in range(20)]
        rows = [np.frombuffer(m.set_parts(s), np.uint8) for one in sets for s in (one, one[: max(1, n * percent // 100)])]
        parts, marks = np.array(rows), m.set_marks(np.array(rows))
        for k in range(40):
            most, got = (parts != parts[k]).sum(axis=1), m.marks_differ(marks, marks[k])
            two = np.array([(parts & 3) != (parts[k] & 3)])[0].sum(axis=1)
            assert (got <= most).all() and (got == two).all() and got[k] == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_unlike_sets_are_told_apart_by_marks_and_parts(percent):
    """The least number of elements that differ is never too high and seldom far too low."""
    rng = np.random.default_rng(percent)
    for n in (20, 150, 400):
        some = mix(rng.integers(0, 1 << 62, n).astype(U))
        sets = [np.append(some[d:], mix(rng.integers(0, 1 << 62, d).astype(U))) for d in rng.integers(0, n // 4 + 1, 60)]
        true = np.array([len(np.setxor1d(some, s)) for s in sets])
        parts = np.array([np.frombuffer(m.set_parts(s), np.uint8) for s in [some, *sets]])
        marks = m.set_marks(parts)
        for got, share in ((m.parts_apart(parts[1:], parts[:1]), 0.97), (m.marks_apart(marks[1:], marks[0]), 0.85)):
            assert (got <= true).all() and got.sum() >= share * true.sum()


def test_near_copies_that_are_not_similar_stay_in_their_blocks(spark, monkeypatch):
    """Copies of one text that differ from each other by a little more than similar sets
    may: few pairs of the group leave its blocks, not as many as grow with its square."""
    rng = np.random.default_rng(6)
    base, n, members, own = mix(rng.integers(0, 1 << 62, 150).astype(U)), 150, 60, 12
    sets = [np.append(np.delete(base, rng.choice(n, own, replace=False)), mix(rng.integers(0, 1 << 62, own).astype(U))) for _ in range(members)]
    apart = [len(np.setxor1d(a, b)) for k, a in enumerate(sets) for b in sets[:k]]
    assert min(apart) > 2 * n * 20 // 180
    held = spark.createDataFrame([(k, n, bytearray(m.set_parts(s))) for k, s in enumerate(sets)], "class long, n int, parts binary")
    where, sent, possible = spark.createDataFrame([(0, k) for k in range(members)], "band long, class long"), [], m.possible
    monkeypatch.setattr(m, "possible", lambda pairs, *rest: sent.append(pairs.count()) or possible(pairs, *rest))
    m.unlike_pairs(where, spark.createDataFrame([], "class long, label long"), held, 80, 2).count()
    assert sent[0] <= members


def test_what_meets_in_a_place_is_small(spark, monkeypatch):
    """Rows that are copied to every block of a place carry a quarter of the parts."""
    sets = [shingles(t, 3) for _, t in corpus(9, 25, 80)]
    members = spark.createDataFrame([(0, k) for k in range(len(sets))], "band long, class long")
    labels, held, widths = spark.createDataFrame([], "class long, label long"), table(spark, sets), []
    met = type(members).sortWithinPartitions

    def widest(self, *keys):
        kind = [f.name for f in self.schema if f.dataType.simpleString() == "binary"][0]
        widths.append(self.agg(m.F.max(m.F.length(kind))).collect()[0][0])
        return met(self, *keys)

    monkeypatch.setattr(type(members), "sortWithinPartitions", widest)
    assert m.unlike_pairs(members, labels, held, 80, 2).count() and widths == [m.PARTS // 4]


def long_texts(rng, n):
    """Texts of n words each that share 97, 50 and no % of their places with the first."""
    base = rng.integers(0, 10**9, n)
    texts = [base]
    for share in (0.97, 0.5, 0.0):
        text, some = base.copy(), rng.permutation(n)[: round((1 - share) * n)]
        text[some] = rng.integers(10**9, 2 * 10**9, len(some))
        texts.append(text)
    return [" ".join(map(str, t)) for t in texts]


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_large_sets_are_told_apart_before_texts_move(spark, n):
    texts = long_texts(np.random.default_rng(n), n)
    sets = [m.document_set(np.frombuffer(t.encode(), np.uint8), 1) for t in texts]
    names = [m.set_class(s) for s in sets]
    rows = [(name, len(s), bytearray(m.set_parts(s)), t) for name, s, t in zip(names, sets, texts, strict=True)]
    held = spark.createDataFrame(rows, "class long, n int, parts binary, text string")
    pairs = spark.createDataFrame([(names[0], x) for x in names[1:]], "a long, b long")
    fits = {r.b for r in m.finely_possible(m.possible(pairs, held, 80), held, 1, 80).collect()}
    assert fits == {names[1]}
    assert [(r.a, r.b) for r in m.similar(pairs, held, 1, 80, 2).collect()] == [(names[0], names[1])]


def test_fine_parts_differ_in_no_more_than_elements():
    rng = np.random.default_rng(2)
    for n, d in ((1100, 100), (5000, 1200), (5000, 2600)):
        some = mix(rng.integers(0, 1 << 62, n).astype(U))
        other = np.append(some[d:], mix(rng.integers(0, 1 << 62, d // 3).astype(U)))
        one, two = m.fine_parts(some), m.fine_parts(other)
        assert all(len(s) / 2 <= len(p) for s, p in ((some, one), (other, two)))
        parts = min(len(one), len(two))
        got = m.parts_apart(m.folded(one, parts)[None], m.folded(two, parts)[None])[0]
        assert 0.5 * (d + d // 3) < got <= d + d // 3


def test_only_texts_that_may_be_wanted_are_kept(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 3000).tolist()
    rows = spark.createDataFrame([(k, "x") for k in keys], "class long, text string")
    bits = m.bitmap(spark.createDataFrame([(k,) for k in keys[:40]], "k long"))
    got = {r["class"] for r in m.among(rows, bits).collect()}
    assert set(keys[:40]) <= got and len(got) < 60 and bits.nbytes * 8 == m.BITS
    assert m.among(rows, m.bitmap(rows.limit(0).select("class"))).count() == 0
