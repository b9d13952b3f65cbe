import zlib

import numpy as np
import pyarrow as pa
import pytest

from quayline.llm import languages as g
from quayline.llm.hashing import text_bytes


def data(text):
    return next(text_bytes(pa.array([text])))


def plain_em(likelihoods, prior):
    """The same mixture, one word and one language at a time."""
    n, size = likelihoods.shape
    shares = list(prior)
    for _ in range(g.ROUNDS):
        sums = [0.0] * size
        for row in likelihoods:
            top = max(row)
            odds = [np.exp(x - top) * s for x, s in zip(row, shares, strict=True)]
            for k in range(size):
                sums[k] += odds[k] / sum(odds)
        shares = [(s + g.PRIOR * p) / (n + g.PRIOR) for s, p in zip(sums, prior, strict=True)]
    return shares


def test_mixture_equals_plain_loop():
    rng = np.random.default_rng(1)
    ll, prior = rng.normal(-9, 2, (40, 3)), np.array([0.5, 0.3, 0.2])
    assert g.mixture(ll, prior)[0] == pytest.approx(plain_em(ll, prior))


def test_grams_by_word(monkeypatch):
    from quayline.llm import hashing

    bins, starts = g.grams(data("Ab, c é!"))
    assert len(starts) == 3 and len(bins) == 2 + 1 + 2
    text = "ab c dé " * 100
    logs = np.random.default_rng(2).normal(size=(2, g.BINS)).astype(np.float32)
    whole = g.word_likelihoods(data(text), logs)
    monkeypatch.setattr(hashing, "PIECE", 50)
    assert g.word_likelihoods(data(text), logs) == pytest.approx(whole)


def test_mixed_text(spark):
    """Proportions of a text that is two thirds one language and a third another."""
    labelled = spark.createDataFrame(
        [("x", "abra cadabra barca abaca " * 20), ("y", "tilito linoti notili toli " * 20), (None, "zzz " * 50), ("x", None)],
        "lang string, text string",
    )
    docs = spark.createDataFrame(
        [
            (1, "barca cadabra abaca abra " * 10 + "toli notili " * 10),
            (2, "toli tilito " * 30),
            (3, None),
            (4, "123 !? 。"),
            (5, ""),
            (6, "é"),
            (6, "é"),
        ],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in g.identify(docs, labelled).collect()}
    assert rows[1].lang_pred == "x" and rows[1].score == pytest.approx(2 / 3, abs=0.05) and len(rows[1].languages) == 2
    assert rows[2].lang_pred == "y" and rows[2].score == 1.0
    assert [rows[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and rows[3].score == 0
    assert rows[6].lang_pred in ("x", "y")
    assert {r.lang_pred for r in g.identify(docs, labelled.limit(0)).collect()} == {"und"}
    assert g.identify(docs.limit(0), labelled).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = g.op10_languages(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right > 0.97 * len(held)


def test_copies_teach_once(spark):
    from pyspark.sql import functions as F

    rows = [("x", f"abra cadabra{'ab' * i} barca " * 3) for i in range(40)] + [("y", f"toli{'to' * i} notili " * 3) for i in range(5)]
    once = spark.createDataFrame(rows, "lang string, text string").cache()
    hot = once.where("text like 'abra cadabraababab %'").crossJoin(spark.range(300)).select("lang", "text")
    copies = once.where("lang = 'y'").crossJoin(spark.range(400)).select("lang", "text")
    for fit_docs in (20, 3000):
        names, logs, _ = g.learn(once, fit_docs)
        again, tables, shares = g.learn(once.unionByName(hot).unionByName(copies).repartition(5, F.rand(1)), fit_docs)
        assert again == names and (tables == logs).all()
        # Every text of the small language is learned from, and shares are those of all rows.
        assert (logs[1] > logs[1].min()).sum() > 8 and shares == pytest.approx(np.array([340, 2005]) / 2345)
