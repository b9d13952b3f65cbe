import random

import numpy as np
import pytest

from quayline.llm import linking
from quayline.llm import minhash as m
from quayline.llm.hashing import U, mix
from tests.llm.test_jaccard import brute, corpus


def elements(rng, n):
    return mix(rng.integers(0, 1 << 62, n).astype(U))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 400, 5000])
def test_every_coordinate_is_filled(n):
    made = m.sketch(elements(np.random.default_rng(n), n), 265)
    assert (made != m.EMPTY).all()
    # The rounds that the sketch took: a few for large sets, no more than 2 t for any.
    assert int((made >> U(32)).max()) < (2 * 265 if n < 5 else 40 * 265 // n + 2)


def test_sketch_is_the_least_value_of_all_rounds():
    """Against the definition: all 2 t rounds, without stopping."""
    rng = np.random.default_rng(3)
    for n in (1, 3, 17, 100):
        for t in (5, 40):
            some, want = elements(rng, n), [None] * t
            for i in range(2 * t):
                for x in mix(some + mix(np.array([i], U))).tolist():
                    b = (x >> 32) * t >> 32 if i < t else i - t
                    value = i << 32 | x & 0xFFFFFFFF
                    want[b] = value if want[b] is None else min(want[b], value)
            assert m.sketch(some, t).tolist() == want


def test_agreement_estimates_similarity():
    rng, t = np.random.default_rng(4), 265
    for n, share in ((8, 0.75), (60, 0.8), (1000, 0.8), (1000, 0.5)):
        shares = []
        for _ in range(60):
            all_of = elements(rng, n)
            both = int(n * share)
            a, b = all_of[: (both + n) // 2], np.concatenate([all_of[:both], all_of[(both + n) // 2 :]])
            shares.append((m.sketch(a, t) == m.sketch(b, t)).mean())
        assert abs(np.mean(shares) - share) < 0.02
        assert np.std(shares) < 1.4 * (share * (1 - share) / t) ** 0.5


def test_bounds():
    assert m.band_count(80) == 53 and (1 - 0.8**5) ** 53 < 1e-9
    assert m.least_agreement(100, 80, 0.5) == 80 and 150 < m.least_agreement(265, 80) < 180
    for percent in (50, 100):
        with pytest.raises(ValueError):
            m.band_count(percent)


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 90), (1, 60)])
def test_equals_brute_force(spark, size, percent):
    docs = corpus(size + 20, 50, percent) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (7, "x  y"), (1005, "x y")]
    df = spark.createDataFrame([(*d, 0, "c", b"s") for d in docs], "doc_id long, text string, id long, class string, sketch binary").repartition(5)
    rows = m.near_duplicates(df, size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(docs, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chain_without_a_common_centre(spark, monkeypatch):
    """Neighbours are similar, ends are not: all links are found though blocks are small."""
    monkeypatch.setattr(linking, "BLOCK", 3)
    monkeypatch.setattr(linking, "SPOKES", 2)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(words[12 * k : 12 * k + 100])) for k in range(25)] + [(100, "quite another text of some words here")]
    random.Random(2).shuffle(docs)
    got = m.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1, 75).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs, 1, 75)
    assert {r.component_id for r in got} == {0, 100}


def test_large_groups(spark):
    """A third are copies of one text, a third near copies with edits of their own."""
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(300)]
    rng = random.Random(3)
    for i in range(300, 600):
        copy = list(base)
        copy[rng.randrange(200)] = copy[rng.randrange(200)] = f"n{i}"
        docs.append((i, " ".join(copy)))
    docs += [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(600, 900)]
    rows = m.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 4, 80).collect()
    assert len(rows) == 900 and {r.component_id for r in rows if r.doc_id < 600} == {0}
    assert all(r.kept for r in rows if r.doc_id >= 600)


def test_ids_of_text_null_ids_and_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(60_000))
    docs = [("b", "one two three four five six seven"), ("a", "One two three four five six  seven"), (None, "x y z u v w"), (None, "x y z u v w"), ("c", long), ("d", long + " end"), ("d", long + " end")]
    rows = m.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string"), 4, 80).collect()
    got = sorted((r.doc_id or "-", r.component_id or "-", r.kept) for r in rows)
    assert got == [("-", "-", True), ("-", "-", True), ("a", "a", True), ("b", "a", False), ("c", "c", True), ("d", "c", False), ("d", "c", False)]


def test_empty_table(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in m.op11_minhash(spark, sf).collect())
    assert got == brute(docs, 4, 80)
