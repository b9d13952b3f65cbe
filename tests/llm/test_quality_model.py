import numpy as np
import pyarrow as pa

from quayline.llm import quality_model as q
from quayline.llm.hashing import text_bytes


def data(text):
    return next(text_bytes(pa.array([text])))


def test_shapes_and_echoes():
    def shapes(text):
        d = data(text)
        return q.word_shapes(d, *q.word_borders(d)).tolist()

    a, b, c, e, f = shapes("anor*** tion*** Tion*** TION, 12")
    assert a == b and len({a, c, e, f}) == 4
    assert shapes("x!!! y!!!!!")[0] == shapes("y!!!")[0] and shapes("") == [] == shapes(" \n")
    words, bins = q.word_features(data("a a a b"))
    assert len(words) == 4 and (bins == 1).sum() >= 2


def test_parts_do_not_matter(monkeypatch):
    from quayline.llm import hashing

    text = "Some words some WORDS!! 12 é é é " * 300
    whole = np.sort(q.word_features(data(text))[1])
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (np.sort(q.word_features(data(text))[1]) == whole).all()


def test_votes():
    assert q.heuristic_votes(data("x"), q.word_features(data(""))[0])[-1] == "-"
    junk = "aa*** bb### " * 30
    assert q.heuristic_votes(data(junk), q.word_features(data(junk))[0])[2] == "-"


def test_edges(spark):
    texts = [None, "", " \n", "Plain words make a sentence, as they should. " * 5, "x", "x"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = {r.doc_id: r for r in q.quality_scores(docs).collect()}
    assert len(rows) == 6 and all(rows[i].score == 0 and not rows[i].kept for i in range(3))
    assert rows[4].score == rows[5].score
    assert q.keep_good(docs).schema == docs.schema
    assert q.quality_scores(docs.limit(0)).count() == 0 and q.keep_good(docs.limit(0)).count() == 0


def test_agrees_with_labels(spark):
    """The labels table is never used for training, so all of it is held out."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q.op4_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad = [r for r in labels if r.quality == 0]
    good = [r for r in labels if r.quality == 1]
    assert sum(not rows[r.doc_id].kept for r in bad) >= 0.9 * len(bad)
    assert sum(rows[r.doc_id].kept for r in good) >= 0.97 * len(good)


def test_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: r.score for r in q.quality_scores(docs).collect()}
    assert a == {r.doc_id: r.score for r in q.quality_scores(docs.repartition(7)).collect()}


def test_copies_do_not_starve_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    good = [f"Plain words number{i} make a sentence{i}, as they should here. " * 3 for i in range(30)]
    junk = [f"aa*** bb### cc@@@ {i}%% " * 20 for i in range(10)]
    once = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *junk, None, " "])], "doc_id long, text string").cache()
    copies = once.crossJoin(spark.range(60).select(F.col("id").alias("copy"))).repartition(5)
    fit, sizes = q.fit_linear, []
    monkeypatch.setattr(q, "fit_linear", lambda rows: (sizes.append(len(rows)), fit(rows))[1])
    rows = q.quality_scores(copies, fit_docs=50).collect()
    q.train(copies, fit_docs=25)
    q.train(once, fit_docs=25)
    assert sizes == [40, 25, 25] and len(rows) == 42 * 60
    assert {r.doc_id for r in rows if r.kept} == set(range(30))


def test_names_of_many_texts(spark):
    texts = spark.range(3000).selectExpr("concat('text ', id % 2000) as text")
    names = sorted({r[0] for r in texts.selectExpr("xxhash64(text)").collect()})
    assert [q.least_name(texts, n) for n in (1, 100, 1999, 2000, 2001)] == [names[0], names[99], names[1998], None, None]
