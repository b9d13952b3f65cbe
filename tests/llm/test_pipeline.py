import hashlib

import public_tokenizers
import pytest
from test_decontaminate import brute as brute_hits
from test_jaccard import brute as brute_groups
from tokenizers import Tokenizer

import corpus_pipeline as p
from quayline.llm import quality_model, secrets

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def check(spark, docs, tmp_path, sf_dir):
    """Run the stages one by one; compare each with plain Python on what came before."""
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))
    for name, stage in p.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name == "quality":
            scores = quality_model.quality_scores(spark.createDataFrame(before, docs.schema))
            good = sorted(r.doc_id for r in scores.collect() if r.kept)
            assert sorted(r.doc_id for r in after) == good
        elif name == "duplicates":
            groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted({c for i, n, c in groups if n} | {i for i, n, c in groups if not n})
        elif name == "benchmark":
            clean = [r.doc_id for r in before if brute_hits(r.text, bench, 10)[1] == 0]
            assert sorted(r.doc_id for r in after) == sorted(clean)
        elif name == "secrets":
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                assert r.text == secrets.redacted(texts[r.doc_id], secrets.scan(texts[r.doc_id]), "[secret]")
                assert r.n_chars == len(r.text) and not secrets.scan(r.text)
        else:
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
                assert r.ids == ids and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    return after


def test_stages_equal_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.columns == COLUMNS
    rows = check(spark, docs, tmp_path, SF)
    assert 0 < len(rows) < docs.count()


def test_run(spark):
    assert p.run(spark, SF).count() > 0 and [n for n, _ in p.STAGES] == ["quality", "duplicates", "benchmark", "secrets", "tokens"]


@pytest.mark.parametrize("rows", [[], "odd"])
def test_odd_documents(spark, tmp_path, rows):
    letters = "abcdefghij"
    words = " ".join(f"The {a}ord{b} was near a {b}ill{a}, and it stood." for a in letters for b in letters[:4])
    if rows:
        rows = [
            (1, words, "en", None, len(words)), (1, words, "en", None, len(words)), (2, None, None, "s", None), (3, "", "en", "s", 0),
            (None, words + " end", "en", "s", len(words) + 4), (4, words + " token = abcdefgh1234", "x", "s", len(words) + 21),
        ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert [r.doc_id for r in docs.collect()] == ([1] if rows else [])


def test_short_items_drop_nothing(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(10))
    spark.createDataFrame([("a", "Paris"), ("b", passage), ("c", "the river")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "Paris lies by the river."), (2, f"so {passage} on"), (3, passage[:-6])], "doc_id long, text string")
    assert sorted(r.doc_id for r in p.benchmark(spark, docs, str(tmp_path)).collect()) == [1, 3]
