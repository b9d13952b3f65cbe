import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import connect, mismatch  # noqa: E402

from quayline.llm import decontaminate as d  # noqa: E402

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    names.add(name)
    return len(own), len(hit), sorted(names)


ITEMS = [
    ("q1", "The quick brown fox jumps over the lazy dog."),
    ("q10", "Quick brown Fox"),
    ("q2", "é é é é"),
    ("q3", ""),
    ("q4", None),
    ("q1", "lazy dog the quick"),
]
TEXTS = [
    None,
    "",
    "...",
    "THE  quick-brown\nfox jumps. Over the lazy dog the quick brown fox",
    "xthe quick brown fo",
    "é é é é é é x é é é é",
    "quick brown fox " * 40,
    "a " * 30_000 + "quick brown fox jumps over" + " b" * 30_000,
]


@pytest.mark.parametrize("block_words", [20_000, 4])
def test_equals_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(d, "BLOCK_WORDS", block_words)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert (len(d.blocks(bench, "item_id", "text")) > 1) == (block_words == 4)
    rows = d.contamination(docs, bench, window=5, keep_text=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, ITEMS, 5)
        assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    kept = d.decontaminate(docs, bench, window=5)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if brute(t, ITEMS, 5)[1] == 0]


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, none).collect()] == [(2, 0, [])]
    assert d.decontaminate(docs, none).count() == 1
    assert d.decontaminate(docs.limit(0), none).count() == 0


def test_query_equals_sql(spark):
    df = d.op6_decontaminate(spark, "/root/testdata/sf0.001")
    assert mismatch(connect("sf0.001"), df, d.ORACLE) is None
