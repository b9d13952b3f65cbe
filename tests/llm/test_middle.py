import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayline.llm import middle as m


def brute(doc_id, text):
    """The contract, on whole texts."""
    text = text or ""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n, sha = len(text), lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, e = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, mid, suffix = text[:p], text[p:e], text[e:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(mid), sha("<S>" + suffix + "<P>" + prefix + "<M>" + mid), sha(text)
    return doc_id, n, "psm", len(prefix), len(mid), sha("<P>" + prefix + "<S>" + suffix + "<M>" + mid), sha(text)


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def values(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM/a", max_size=30), st.integers(0, 30), st.integers(0, 30), st.integers(1, 7), st.sampled_from(["psm", "spm", "plain"]))
def test_restores_any_text_from_any_pieces(text, x, y, chunk, form):
    if any(mark in text for mark in m.MARKS.values()):
        form = "plain"
    first, second = sorted((min(x, len(text)), min(y, len(text))))
    whole = "".join(m.output_pieces(text, form, first, second, chunk))
    assert m.restored_text(form, whole) == text
    restorer, found = m.Restorer(form), {"P": "", "M": "", "S": ""}
    for piece in [whole[k : k + chunk] for k in range(0, len(whole), chunk)]:
        for section, part in restorer.feed(piece):
            found[section] += part
    for section, part in restorer.end():
        found[section] += part
    assert found["P"] + found["M"] + found["S"] == text
    if form != "plain":
        assert (found["P"], found["M"]) == (text[:first], text[first:second])


@pytest.mark.parametrize("chunk", [1, 7, 16_384])
def test_equals_brute_force(spark, chunk):
    texts = ["plain words here", "", None, "a", "<", "<<<", "has <M> inside", "ends <P", "🙂 é 語" * 9, "P>S>M>" * 5, "x" * 50, "\n\t", "\x00b"]
    docs = [(k, t) for k, t in enumerate(texts * 6)] + [(5, "repeated"), (5, "repeated"), (5, "unlike"), (None, "no id"), (None, "no id"), (-3, "below")]
    df = spark.createDataFrame([(*d, 1, "n", "psm") for d in docs], "doc_id long, text string, place long, name string, form string").repartition(5)
    got = values(m.fim_digests(df, chunk=chunk))
    assert got == sorted((brute(*d) for d in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_long_texts_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(m, "BATCH_CHARS", 5_000)
    docs = [("a", "word " * 300_000), ("b", "ü" * 70_001), ("c", "short")]
    assert values(m.fim_digests(spark.createDataFrame(docs, "doc_id string, text string"))) == sorted(brute(*d) for d in docs)


def test_whole_texts_go_both_ways(spark):
    docs = [(k, f"text number {k} " * k) for k in range(40)] + [(41, None)]
    made = m.transformed(spark.createDataFrame(docs, "doc_id int, text string"), chunk=20)
    rows = {r.doc_id: r for r in made.collect()}
    assert all(hashlib.sha256(rows[d].output.encode()).hexdigest() == brute(d, t)[5] for d, t in docs)
    back = {r.doc_id: r.text for r in m.restore(made).collect()}
    assert back == {d: t or "" for d, t in docs}


def test_one_shuffle_however_it_is_sorted(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = m.fim_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_empty_table(spark):
    assert m.fim_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert values(m.op13_middle(spark, sf)) == sorted((brute(*d) for d in docs), key=repr)
