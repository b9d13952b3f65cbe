import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quayline.llm.bpe import bpe, decode, encode, op1_bpe, read_spec, round_trip

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXTS = [
    "",
    " \n\t",
    "Hello  don't Straße ΣΑΣ x́ é İ 123abc <|endoftext|>foo!!! <b>\x1c a b 你好 😀‍👩",
    "we'll I'VE 'tis '' !'s ́ a\u0085b c <|startoftext|><|endoftext|> <|x|>",
    "a" * 3000 + "the quick brown fox " * 50 + "ab!" * 700,
    "tionthe" * 400,
    "a\x00b�\U0010ffff",
]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = public_tokenizers.path(request.param)
    return bpe(read_spec(path)), Tokenizer.from_file(path)


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    data = own.encode(text)
    got = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]
    assert got == want
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(both, text):
    same(*both, text)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(
    st.text(max_size=60),
    st.text("abthein'sdrvmĺéÉß \n!&<|>endoftx12", max_size=80),
    st.lists(st.sampled_from(["the", "tion", "é", "ß", "##", " ", "'re", "<|endoftext|>", "Σ"]), max_size=30).map("".join),
))
def test_equals_library_on_any_text(text):
    for name in NAMES:
        path = public_tokenizers.path(name)
        same(bpe(read_spec(path)), library(path), text)


def library(path, made={}):  # noqa: B006
    if path not in made:
        made[path] = Tokenizer.from_file(path)
    return made[path]


def test_long_fragments_take_the_heap(both):
    same(*both, "thequickbrownfoxjumpsoverthelazydog" * 60)


def test_cuts_are_at_pairs_outside_tokens():
    own = bpe(read_spec(public_tokenizers.path(NAMES[0])))
    assert own.cuts and (ord("t"), ord("h")) not in own.cuts


def test_frames(spark):
    path = public_tokenizers.path(NAMES[1])
    docs = spark.createDataFrame(
        [(1, "one two", "x", "y"), (2, None, "x", "y"), (None, "", "x", "y"), (1, "one two", "x", "y")],
        "doc_id long, text string, ids string, n_tokens string",
    )
    ids = encode(docs, path)
    assert ids.columns == ["doc_id", "ids"]
    back = sorted((r.doc_id or 0, r.text) for r in decode(ids, path).collect())
    assert back == [(0, ""), (1, "one two"), (1, "one two"), (2, "")]
    empty = "".encode()
    rows = {r.doc_id: r for r in round_trip(docs, path).collect()}
    assert rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(empty).hexdigest()
    assert encode(docs.limit(0), path).count() == 0


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = library(public_tokenizers.path(NAMES[0]))
    rows = {r.doc_id: r for r in op1_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
