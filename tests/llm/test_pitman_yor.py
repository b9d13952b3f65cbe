import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.llm import pitman_yor as m
from quayline.llm.hashing import U


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain_base(docs):
    """(n_tokens, n_known, train_tokens, base) by the contract's formula."""
    count = Counter(w for _, t, out in docs if not out for w in words(t))
    total, distinct = sum(count.values()), len(count)
    return {
        i: (len(words(t)), sum(count[w] > 0 for w in words(t)), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words(t)))
        for i, t, _ in docs
    }


def bucket(rng, n_words, n_contexts):
    pairs = [(w, c) for w in range(n_words) for c in range(n_contexts)]
    part = {
        "block": 0, "words": m.pack(np.arange(n_words, dtype=U)), "spans": m.pack(np.full(n_words, n_contexts, np.int32)),
        "contexts": m.pack(np.array([c * 37 % m.CONTEXTS for _, c in pairs], np.int16)),
        "counts": m.pack(rng.integers(0, 5, len(pairs)).astype(np.int32) * rng.integers(0, 2, len(pairs)).astype(np.int32)),
    }
    return m.Bucket([part])


def totals_of(b, t, s, r, q, z):
    return {
        "customers": np.bincount(b.context, b.count, m.CONTEXTS), "tables": np.bincount(b.context, t, m.CONTEXTS),
        "parent_customers": np.bincount(b.parent, s, m.PARENTS), "parent_tables": np.bincount(b.parent, r, m.PARENTS),
        "root_customers": float(q.sum()), "root_tables": float(z.sum()), "vocabulary": float(len(b.words)),
    }


def test_probabilities_of_a_context_sum_to_one():
    b = bucket(np.random.default_rng(1), 50, 8)
    start = totals_of(b, *m.at_first(b))
    for state in m.seatings(b, [start], 3, 2):
        t, s, r, q, z = state
        assert (t <= b.count).all() and ((t > 0) == (b.count > 0)).all() and (r <= s).all() and (z <= q).all()
        totals = totals_of(b, *state)
        p = m.predictive(b, totals, state)
        for c in np.unique(b.context):
            (d0, d1, d2), (s0, s1, s2) = m.DISCOUNT, m.STRENGTH
            g = m.PARENT_OF[c]
            unknown = (s2 + d2 * totals["root_tables"]) / (totals["vocabulary"] + 1) / (s2 + totals["root_customers"])
            unknown *= (s1 + d1 * totals["parent_tables"][g]) / (s1 + totals["parent_customers"][g])
            unknown *= (s0 + d0 * totals["tables"][c]) / (s0 + totals["customers"][c])
            assert p[b.context == c].sum() + unknown == pytest.approx(1)


def set_weight(n, t, d):
    """Summed weight of all ways to seat n customers at t tables, one by one."""
    ways = {(): 1.0}
    for _ in range(n):
        grown = Counter()
        for tables, weight in ways.items():
            grown[(*tables, 1)] += weight
            for k, size in enumerate(tables):
                grown[(*tables[:k], size + 1, *tables[k + 1 :])] += weight * (size - d)
        ways = grown
    return sum(w for tables, w in ways.items() if len(tables) == t)


@pytest.mark.parametrize("d", m.DISCOUNT)
def test_weights_of_seatings(d):
    for n in range(1, 8):
        for t in range(1, n + 2):
            got = m.log_stirling(d, np.array([n]), np.array([t]))[0]
            want = set_weight(n, t, d)
            assert math.exp(got) == pytest.approx(want) if want else got == -np.inf


@pytest.mark.parametrize("d", m.DISCOUNT)
def test_integral_meets_the_table(monkeypatch, d):
    t = np.arange(1, 225)
    table = m.log_stirling(d, np.full(len(t), 256), t)
    monkeypatch.setattr(m, "TABLE", 20)
    monkeypatch.setattr(m, "LOG_FACTORIAL", m.LOG_FACTORIAL[:21])
    monkeypatch.setattr(m, "STIRLING", {d: m.stirling_table(d)})
    assert m.log_stirling(d, np.full(len(t), 256), t) == pytest.approx(table, abs=1e-3)
    # One table of n customers weighs Gamma(n - d) / Gamma(1 - d).
    n = 10**9
    assert m.log_stirling(d, np.array([n]), np.array([1]))[0] == pytest.approx(math.lgamma(n - d) - math.lgamma(1 - d), rel=1e-9)


def test_rise():
    for a in (5.0, 14.3, 2000.0):
        for k in (0, 1, 7, 500):
            got = m.rise(np.array([a]), np.array([float(k)]))[0]
            assert got == pytest.approx(math.lgamma(a + k) - math.lgamma(a), abs=1e-5)


def test_gibbs_has_the_exact_posterior():
    """One word in three restaurants, two of which share a parent, beside fixed tables of
    other words: means over the chain against enumerating all seatings with their weights."""
    counts, contexts = [4, 3, 2], [0, 1, m.STEMS]
    part = {
        "block": 0, "words": m.pack(np.zeros(1, U)), "spans": m.pack(np.array([3], np.int32)),
        "contexts": m.pack(np.array(contexts, np.int16)), "counts": m.pack(np.array(counts, np.int32)),
    }
    b = m.Bucket([part])
    own = totals_of(b, *m.at_first(b))
    others = {"tables": 9.0, "parent_customers": 30.0, "parent_tables": 12.0, "root_customers": 40.0, "root_tables": 20.0}
    totals = {k: v + others.get(k, 0) for k, v in own.items()} | {"vocabulary": 6.0}
    (d0, d1, d2), (s0, s1, s2) = m.DISCOUNT, m.STRENGTH

    def new(strength, discount, before, tables):
        return math.prod(strength + discount * (before + j) for j in range(tables))

    def served(strength, before, customers):
        return math.prod(strength + before + j for j in range(customers))

    weights = {}
    for t in product(*[range(1, c + 1) for c in counts]):
        s = (t[0] + t[1], t[2])
        for r in product(range(1, s[0] + 1), range(1, s[1] + 1)):
            for z in range(1, sum(r) + 1):
                w = math.prod(set_weight(c, k, d0) * new(s0, d0, 9, k) for c, k in zip(counts, t, strict=True))
                w *= math.prod(set_weight(c, k, d1) * new(s1, d1, 12, k) / served(s1, 30, c) for c, k in zip(s, r, strict=True))
                w *= set_weight(sum(r), z, d2) * new(s2, d2, 20, z) / served(s2, 40, sum(r)) * (1 / 7) ** z
                weights[(*t, *r, z)] = w
    total = sum(weights.values())
    want = np.sum([np.array(k) * w / total for k, w in weights.items()], axis=0)
    seen = [np.concatenate([t, r, z]) for t, _, r, _, z in m.seatings(b, [totals], 6000, 5)]
    assert np.abs(np.mean(seen[100:], axis=0) - want).max() < 0.06


def test_steps_beyond_the_weighed_numbers(monkeypatch):
    """Metropolis steps and weighing every number agree on 30 customers."""
    args = (np.full(3000, 30), np.full(3000, 5.0), 0.75, np.full(3000, 40.0), lambda i, k: k * math.log(0.02))
    weighed = m.redraw(*args, np.random.default_rng(1))
    monkeypatch.setattr(m, "SINGLY", 8)
    stepped, rng = args[1], np.random.default_rng(2)
    for _ in range(8):
        stepped = m.redraw(args[0], stepped, *args[2:], rng)
    assert stepped.mean() == pytest.approx(weighed.mean(), rel=0.04)
    assert stepped.std() == pytest.approx(weighed.std(), rel=0.1)


def test_chain_goes_on_between_rounds():
    """A round begins where the one before ended, and is the same whenever it is run."""
    b = bucket(np.random.default_rng(1), 30, 8)
    first = totals_of(b, *m.at_first(b))
    ends = list(m.seatings(b, [first], m.SWEEPS, 3))[-1]
    second = totals_of(b, *ends)
    once, again = (list(m.seatings(b, [first, second], 2, 3)) for _ in range(2))
    assert all((x == y).all() for x, y in zip(once[-1], again[-1], strict=True))
    assert any((x != y).any() for x, y in zip(once[-1], ends, strict=True))


def test_pack():
    for values in (np.zeros(0, np.int32), np.arange(5, dtype=np.int64), np.array([1.5, -2], np.float32)):
        assert (m.unpack(m.pack(values), values.dtype) == values).all()


DOCS = [(1, "a b A c", False), (2, None, False), (3, "", True), (4, "a x\ty a", True), (5, "b " * 3000 + "é", False), (5, "b " * 3000 + "é", False)]


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_edges(spark, monkeypatch, block_words):
    monkeypatch.setattr(m, "BLOCK_WORDS", block_words)
    df = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, out boolean, score string").coalesce(1)
    rows = m.language_model_scores(df, F.col("out")).collect()
    assert len(rows) == len(DOCS)
    want = plain_base(DOCS)
    for r in rows:
        n_tokens, n_known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert m.language_model_scores(df.limit(0), F.col("out")).count() == 0
    alone = m.language_model_scores(df, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in m.op2_lm(spark, sf).collect()}
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(rows) == len(docs)
    want = plain_base(docs)
    for i, _, out in docs:
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, *want[i][:3])
        assert r.base_score == pytest.approx(want[i][3])
    held = [r for r in rows.values() if r.held_out]
    perplexity = lambda name: 10 ** (-sum(r[name] for r in held) / sum(r.n_tokens for r in held))
    print("perplexity", perplexity("score"), "base", perplexity("base_score"))
    assert perplexity("score") < 0.8 * perplexity("base_score")


def some_pairs(counts, contexts, names):
    """A bucket of one word: a training count and a context of each pair."""
    packed = (m.pack(np.zeros(1, U)), m.pack(np.array([len(counts)], np.int32)), m.pack(np.array(contexts, np.int32)))
    return m.Pairs((0, *packed, m.pack(np.array(names, U), m.CONTEXT_BYTES), m.pack(np.array(counts, np.int32))))


def test_restaurants_of_words_have_the_exact_posterior():
    """One word after three others, two of one class, beside fixed tables of other words:
    means over the sweeps against enumerating all seatings with their weights."""
    counts, names = [4, 3, 2], [1 << 12 | 5, 2 << 12 | 5, 3 << 12 | 9]
    b = some_pairs(counts, [0, 1, 2], sorted(names))
    t, start = np.array([2.0, 1.0]), np.array([2.0, 2.0, 1.0])
    tables, customers = start + [3, 8, 0], np.zeros(m.CONTEXTS)
    customers[b.group_class] = [30, 12]
    customers[b.group_class] += np.bincount(b.group, start)
    assert b.group.tolist() == [0, 0, 1] and b.group_class.tolist() == [5, 9]
    d, weights = m.WORD_DISCOUNT, {}
    for k in product(*[range(1, c + 1) for c in counts]):
        w = math.prod(set_weight(c, x, d) * math.prod(m.WORD_STRENGTH + d * (o + j) for j in range(x)) for c, x, o in zip(counts, k, [3, 8, 0], strict=True))
        for n, tt, o in ((k[0] + k[1], 2, 30), (k[2], 1, 12)):
            w *= set_weight(n, tt, m.DISCOUNT[0]) / math.prod(m.STRENGTH[0] + o + j for j in range(n))
        weights[k] = w
    total = sum(weights.values())
    want = np.sum([np.array(k) * w / total for k, w in weights.items()], axis=0)
    seen = list(np.copy(k) for k in m.word_sweeps(b, start, t, tables, customers, 6000, np.random.default_rng(3)))
    assert np.abs(np.mean(seen[100:], axis=0) - want).max() < 0.06
    assert all(x[0] + x[1] >= 2 for x in seen)


def test_weights_near_large_classes():
    n, t = np.array([300.0, 5000.0, 90000.0, 300.0]), np.array([40.0, 700.0, 80.0, 299.0])
    near = m.Served(m.DISCOUNT[0], n, t)
    for step in (-30, -1, 0, 7, 32):
        group, at = np.arange(4), n + step
        got, want = near(group, at, np.zeros(4, bool)), m.log_stirling(m.DISCOUNT[0], at, t)
        assert (np.isneginf(got) == np.isneginf(want)).all()
        fits = ~np.isneginf(want)
        assert got[fits] == pytest.approx(want[fits], abs=0.05)


def test_a_word_is_scored_after_the_very_word_before_it(spark):
    """Words that end alike, so of one class, are followed by words of their own."""
    rows = [(k, f"x{k}ab left" if k % 2 else f"y{k}ab right", False) for k in range(6)] * 20
    rows += [(100, "x1ab left", True), (101, "x1ab right", True), (102, "y2ab right", True), (103, "y2ab left", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    got = {r.doc_id: r.score for r in m.language_model_scores(df, F.col("out")).collect()}
    assert got[100] - got[101] > 1 and got[102] - got[103] > 1


@pytest.mark.parametrize("buckets", [1, 7])
def test_probabilities_after_a_word_sum_to_one(spark, monkeypatch, buckets):
    """Over all known words and the unknown one, in texts that hold each pair once."""
    monkeypatch.setattr(m, "bucket_count", lambda *_: buckets)
    words = [f"w{k}" for k in range(12)]
    rng = np.random.default_rng(5)
    train = [(k, " ".join(rng.choice(words, 9)), False) for k in range(30)]
    pairs = [(1000 + k, f"w3 w3 {w}", True) for k, w in enumerate([*words, "new", "", "w3"])]
    df = spark.createDataFrame(train + pairs, "doc_id long, text string, out boolean")
    found = []
    monkeypatch.setattr(m, "block_scores", lambda blocks, answers, shape, totals: found.append((shape, blocks, answers)) or blocks)
    m.language_model_scores(df.coalesce(1), F.col("out"))
    shape, blocks, answers = found[0]
    (block,) = blocks.collect()
    known = m.unpack(block.words, U)
    _, word, context, _ = m.block_pairs(shape, known, m.unpack(block.stream, np.int32), m.unpack(block.sizes, np.int64))
    logs = np.concatenate([m.unpack(r.a, np.float32) for r in sorted(answers.collect(), key=lambda r: r.sender)])
    of = np.searchsorted(known, m.tokens(np.frombuffer(b"w3", np.uint8))[0])
    after = context == of
    assert len(np.unique(word[after])) == after.sum() == 14 and abs((10.0 ** logs[after]).sum() - 1) < 0.05


def test_buckets_agree_with_one(spark, monkeypatch):
    """Counts don't depend on the number of buckets, nor, but for chance, do scores."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice([f"{c}{e}" for c in "pqrstuv" for e in ("ab", "cd", "e")], 60)), k % 5 == 0) for k in range(60)]
    df, found = spark.createDataFrame(rows, "doc_id long, text string, out boolean"), []
    for buckets in (1, 9):
        monkeypatch.setattr(m, "bucket_count", lambda *_, n=buckets: n)
        found.append({r.doc_id: r for r in m.language_model_scores(df, F.col("out")).collect()})
    for i, r in found[0].items():
        other = found[1][i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (other.n_tokens, other.n_known, other.train_tokens)
        assert r.score == pytest.approx(other.score, rel=0.02)
