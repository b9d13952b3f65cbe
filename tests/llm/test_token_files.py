import glob
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayline.llm import token_files as t

WORD = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, path, end):
    library, out, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + end
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


ROWS = [
    (5, "the quick  brown\tfox's <|endoftext|> d\x1cog"),
    (2, None),
    (2, "b"),
    (None, "é ß Σ 你好"),
    (9, ""),
    (7, "word " * 30_000),
    (2, "b"),
]


@pytest.mark.parametrize("name,end", [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 2), ("byte_bpe_50k.json", None)])
def test_files_hold_what_the_library_gives(spark, tmp_path, name, end):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, part int, ids string")
    path, folder = public_tokenizers.path(name), str(tmp_path / "t")
    t.write_tokens(docs.repartition(3), folder, path, end_id=end)
    want = expected(ROWS, path, [] if end is None else [end])
    rows = t.token_digests(spark, folder).collect()
    assert sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == want
    index = t.token_index(spark, folder).collect()
    assert sorted(map(tuple, index), key=str) == sorted([w[:3] for w in want], key=str)


def test_empty(spark, tmp_path):
    t.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), WORD)
    assert t.token_digests(spark, str(tmp_path / "t")).count() == 0


def test_format(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = str(tmp_path / "t")
    t.write_tokens(docs, folder, WORD, row_group_bytes=64 << 10, page_rows=10)
    groups = 0
    for name in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["first"].encodings
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert groups > len(glob.glob(f"{folder}/*.parquet"))
    some = t.token_rows(spark, folder).where(F.col("doc_id").between(10, 12)).select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert some.count() == 3


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, t.op3_token_files(spark, sf).collect())) == expected(docs, WORD, [2])


@pytest.mark.parametrize("hashes", ["two", "unlike words of one name"])
def test_words_are_looked_up_together(monkeypatch, hashes):
    """Texts of many slabs with a small memory get the library's ids, and a word that is
    remembered isn't given to the library again."""
    monkeypatch.setattr(t, "SLAB", 64)
    monkeypatch.setattr(t, "HASHED", 16)
    if hashes != "two":
        two = t.two_hashes
        monkeypatch.setattr(t, "two_hashes", lambda *args: (two(*args)[0] % t.U(3), two(*args)[1]))
    texts = [r[1] for r in ROWS] + ["x" * 300 + " a\u0301 \u0301b of.\nOF \r\x0b of\u00a0of", "c\ud7ff\U0001fae9 <|ENDOFTEXT|>", " ", "\u03a3\u03a3 \u0130<|endoftext|>y"]
    library, encoder = Tokenizer.from_file(WORD), t.LibraryEncoder(t.read_spec(WORD))
    want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    column = t.pa.array(["before", *texts, "after"])[1:-1]
    for most in (1_000_000, 3):
        monkeypatch.setattr(t, "MOST_KNOWN", most)
        for _ in range(2):
            ids, counts = encoder.encode_column(column)
            ends = counts.cumsum().tolist()
            assert [ids[b - n : b].tolist() for b, n in zip(ends, counts.tolist(), strict=True)] == want
            if most == 3 or hashes != "two":
                continue
            monkeypatch.setattr(encoder, "_encode_text", None)
            many = t.pa.array(["the quick brown fox's d\x1cog word é ß Σ 你好"])
            encoder.encode_column(many)
            given = []
            monkeypatch.setattr(encoder, "_encode_new", lambda words: given.extend(words) or [])
            encoder.encode_column(many)
            assert not given
            monkeypatch.undo()
            monkeypatch.setattr(t, "SLAB", 64)
            monkeypatch.setattr(t, "HASHED", 16)
