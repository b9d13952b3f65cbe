import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from quayline.llm import alignment as m
from quayline.llm.bpe import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute(libraries, docs):
    """The contract, token by token, on whole texts given to both libraries."""
    a, b = libraries
    byte = {letter: k for k, letter in enumerate(byte_letters())}
    found, counts = [], Counter()
    for doc_id, text in docs:
        text = text or ""
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        ea, eb = ([0, *np.cumsum([len(t) for t in some]).tolist()] for some in (ta, tb))
        pairs = [(x, y) for i, x in enumerate(ia) for j, y in enumerate(ib) if ea[i] < eb[j + 1] and eb[j] < ea[i + 1]] if len(ia) < 400 else None
        if pairs is None:  # the same by bytes
            owner = [[k for k, t in enumerate(some) for _ in t] for some in (ta, tb)]
            pairs = [(ia[i], ib[j]) for i, j in dict.fromkeys(zip(*owner, strict=True))]
        cuts = sorted(set(ea) & set(eb))
        groups = []
        for start, end in zip(cuts, cuts[1:], strict=False):
            sides = [[i for i, e in zip(ids, ends[1:], strict=True) if start < e <= end] for ids, ends in ((ia, ea), (ib, eb))]
            groups.append("|".join(",".join(map(str, side)) for side in sides))
        counts.update(pairs)
        found.append((doc_id, ia, ib, groups, pairs))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            (d, len(ia), len(ib), len(g), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, ia, ib, g, p in found
        ),
        key=repr,
    ), counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def values(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "   lead", "trail   ", "two  spaces   three", "tab\tand\nline\n\nend\n", "don't we'll I'M",
    "<|endoftext|> <s> </s> <unk> <0x41>", "café naïve 語 語語 \U0001f642\U0001f642", "under▁score", "▁", "\x00 null", " nbsp　wide", "12345 67 8,9.10",
    "é ﬁ ①", "x" * 300, "﻿bom", "a\r\nb", "͸ \U0010ffff", "WORDwordWord_word-word",
]


def test_pieces_encode_as_whole_texts(libraries):
    a, b = m.encoders(m.read_spec(A), open(B, "rb").read())
    rng = random.Random(4)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("ab \n'.é語1 ") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    want = [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    for texts_, one, ids in ((texts, a, want), ([t for t in texts if "▁" not in t], b, None)):
        ids = ids or libraries[1].encode(texts_)
        assert [np.frombuffer(e, "<i4").tolist() for e in one.encode([" " + t for t in texts_])] == ids


def test_links_are_all_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sides = []
        docs = [int(rng.integers(1, 30)) for _ in range(4)]
        for _ in range(2):
            cuts = [sorted({*rng.integers(1, n + 1, rng.integers(0, n + 1)).tolist(), n}) for n in docs]
            base = np.cumsum([0, *docs])
            sides.append([(d, e, int(base[d]) + e) for d, some in enumerate(cuts) for e in some])
        a, b = (m.pa.table({"doc": [s[0] for s in some], "end": [s[1] for s in some], "place": list(range(len(some))), "total": [s[2] for s in some]}) for some in sides)
        starts = [[0, *(s[2] for s in some)] for some in sides]
        want = [(i, j) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if starts[0][i] < y[2] and starts[1][j] < x[2]]
        left, right = m.links(a, b)
        assert list(zip(left.tolist(), right.tolist(), strict=True)) == want
        shared = [[k for k, s in enumerate(some) if s[:2] in {t[:2] for t in sides[1 - n]}] for n, some in enumerate(sides)]
        assert [some.tolist() for some in m.shared_ends(a, b)] == shared


@pytest.mark.parametrize("run_bytes,block_bytes", [(1 << 20, 12 << 20), (40, 150)])
def test_equals_brute_force(spark, libraries, monkeypatch, run_bytes, block_bytes):
    monkeypatch.setattr(m, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(m, "BLOCK_BYTES", block_bytes)
    docs = [(k, t) for k, t in enumerate(TEXTS * 2)] + [(3, "repeated row"), (3, "repeated row"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*d, 1, 2, "g") for d in docs], "doc_id long, text string, block long, place int, groups string").repartition(4)
    found, pairs = m.align(df, A, B, groups=True)
    want, counts = brute(libraries, docs)
    assert values(found) == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(counts)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in found.collect())


def test_a_long_text_and_text_ids(spark, libraries):
    docs = [("long", " ".join(f"word{k % 977}" for k in range(3_000))), ("b", "word1 word2")]
    found, _ = m.align(spark.createDataFrame(docs, "doc_id string, text string"), A, B)
    assert values(found) == brute(libraries, docs)[0]


def test_empty_table(spark):
    found, pairs = m.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.collect() == [] and pairs.collect() == []


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert values(m.op12_alignment(spark, sf)) == brute(libraries, docs)[0]


def test_shared_ends_are_those_of_the_same_text():
    rng = np.random.default_rng(5)
    words = pa.array([b"", b"x", b"yy", b"zzz"], pa.binary())

    def cut(n):
        ids = []
        while n or rng.random() < 0.3:
            ids.append(int(rng.integers(0, min(n, 3) + 1)))
            n -= ids[-1]
        return ids

    sizes = [0, 1, 7, 0, 0, 40, 3] * 20
    sides = [[cut(n) for n in sizes] for _ in range(2)]
    tables = [m.token_ends(m.id_lists([np.array(x, np.int32).tobytes() for x in side]), words) for side in sides]
    ends = [list(zip(t["doc"].to_pylist(), t["end"].to_pylist(), strict=True)) for t in tables]
    for own, other, found in zip(ends, ends[::-1], m.shared_ends(*tables), strict=True):
        assert found.tolist() == [k for k, end in enumerate(own) if end in set(other)]
