import re
from collections import Counter

import pytest

from quayline.llm import quality_rules as q
from quayline.llm import votes


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "a b c a b c a",
    "x x x x x",
    "a b c d a b c e a b\x0bc\x0c|# é😀 <b> x",
    "line\nline \nline\n\n \nline",
    "the a b\n" * 300,
    " ".join(f"w{i % 977}" for i in range(20_000)),
]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 1)], "doc_id long, text string, n_words int")
    rows = q.text_statistics(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = plain("a b" if r.doc_id is None else TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want
    assert q.judge(q.text_statistics(docs.limit(0))).count() == 0


def test_em_recovers_accuracies():
    """Votes drawn from known rates give these rates and the labels back."""
    import random

    rng, truth, counts = random.Random(1), [], Counter()
    right = [0.95, 0.8, 0.7, 0.9, 0.6]
    for _ in range(20_000):
        good = rng.random() < 0.7
        p = "".join("0" if rng.random() < 0.2 else "+-"[(rng.random() < a) != good] for a in right)
        truth.append((p, good))
        counts[p] += 1
    good, rates, share = votes.fit(dict(counts))
    assert share == pytest.approx(0.7, abs=0.04)
    for r, a in zip(rates, right, strict=True):
        assert r["good"]["+"] / (1 - r["good"]["0"]) == pytest.approx(a, abs=0.03)
        assert r["bad"]["-"] / (1 - r["bad"]["0"]) == pytest.approx(a, abs=0.03)
    assert sum((good[p] >= 0.5) == g for p, g in truth) > 0.93 * len(truth)
    assert votes.fit({}) == ({}, [], 1.0)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q.op5_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want, r = plain(d.text), rows[d.doc_id]
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not rows[r.doc_id].base_failed]
    agree = sum(rows[r.doc_id].kept == (r.quality == 1) for r in labels)
    assert agree > 0.95 * len(labels)


def test_native(spark):
    plan = q.op5_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    stats = q.text_statistics(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan += stats._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
