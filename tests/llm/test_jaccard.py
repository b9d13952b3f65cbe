import random
import re

import numpy as np
import pytest

from quayline.llm import jaccard as j
from quayline.llm.hashing import U, mix, text_bytes, word_hashes


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def similar(a, b, percent):
    both = len(a & b)
    return both and 100 * both >= percent * (len(a) + len(b) - both)


def brute(docs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            if root(x) != root(y) and similar(sets[x][1], sets[y][1], percent):
                parent[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, groups, percent):
    """Chains and stars of edited texts, many about as similar as the threshold."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    docs = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 8, 15, 40, 120, 300]))]
        docs.append(base)
        for _ in range(rng.choice([0, 1, 4, 9])):
            copy = list(rng.choice(docs[-3:]) if g % 2 else base)
            for _ in range(rng.randrange(0, 2 + int(len(base) * (100 - percent) / 350))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * (0.85 + 0.15 * rng.random())))]
            docs.append(copy)
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 60)])
def test_equals_brute_force(spark, size, percent):
    docs = corpus(size, 60, percent) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "x y"), (7, "x  y")]
    df = spark.createDataFrame([(*d, 0, "c") for d in docs], "doc_id long, text string, id long, class string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.similarity_groups(df, size, percent).collect())
    assert got == brute(docs, size, percent)


def test_similar_sets_share_signatures():
    """Sets as unlike as a link allows, of all kinds of sizes, always meet."""
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        signer = j.Signer(percent)
        for n in [1, 2, 5, 9, 10, 11, 19, 20, 25, 31, 40, 60, 100, 180, 400, 900] * 6:
            both = int(rng.integers(max(1, n * percent // 100), n + 1))
            most = both * 100 // percent - both
            mine = int(rng.integers(0, most + 1))
            elements = mix(rng.integers(0, 1 << 62, both + most).astype(U))
            a = np.unique(elements[: both + mine])
            b = np.unique(np.concatenate([elements[:both], elements[both + mine :]]))
            assert similar(set(a.tolist()), set(b.tolist()), percent)
            if j.set_class(a) != j.set_class(b):
                assert set(signer.signatures(a).tolist()) & set(signer.signatures(b).tolist())


def test_unlike_sets_share_none():
    rng = np.random.default_rng(6)
    signer = j.Signer(80)
    made = [set(signer.signatures(np.unique(mix(rng.integers(0, 1 << 62, 300).astype(U)))).tolist()) for _ in range(60)]
    assert sum(len(a & b) for k, a in enumerate(made) for b in made[:k]) < 5


def test_hashes_of_words_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    from quayline.llm import hashing

    text = "Éa b\tccc  dd\n" * 500 + "x" * 3000 + " end"
    column = pa.array([text, None, "", "A b"])
    whole = [word_hashes(d) for d in text_bytes(column)]
    monkeypatch.setattr(hashing, "PIECE", 100)
    again = [word_hashes(d) for d in text_bytes(column)]
    assert all((a == b).all() for a, b in zip(whole, again, strict=True))
    assert len(whole[0]) == len(text.split()) and len(whole[1]) == len(whole[2]) == 0
    assert whole[3][0] == word_hashes(np.frombuffer(b"a", np.uint8))[0]


def test_large_groups(spark):
    """Many copies of one text, and many near copies whose edits differ from each other."""
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(300)]
    rng = random.Random(3)
    for i in range(300, 500):
        copy = list(base)
        copy[rng.randrange(200)] = copy[rng.randrange(200)] = f"n{i}"
        docs.append((i, " ".join(copy)))
    rows = j.similarity_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 3, 90).collect()
    assert {r.component_id for r in rows} == {0} and len(rows) == 500


def test_keep_one_passes_all_columns_on(spark):
    rows = [("b", "one two three four five six", 1, 2, 3, 4), ("a", "one two three four five six", 5, 6, 7, 8), (None, "", 9, 9, 9, 9), ("c", None, 0, 0, 0, 0)]
    names = "doc_id string, text string, class int, Kept_Class int, class_of_text int, key_of_text int"
    kept = j.keep_one(spark.createDataFrame(rows * 2, names))
    assert kept.columns == ["doc_id", "text", "class", "Kept_Class", "class_of_text", "key_of_text"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], *[rows[2], rows[3]] * 2], key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert j.similarity_groups(none).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.op7_jaccard(spark, sf).collect())
    assert got == brute(docs, 3, 90)


def test_kept_texts_are_shuffled_once(spark):
    rows = [(None if k % 7 == 0 else k % 50, f"some words of text {k % 9}" if k % 5 else "", "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = j.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "Exchange" not in plan.split("LeftSemi")[0]  # none above the join
        got = sorted((r.text, r.doc_id) for r in kept.collect() if r.text)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    worded = [(text, i) for i, text, _ in rows if text and i is not None]
    assert got == sorted((text, min(i for t, i in worded if t == text)) for text in {t for t, _ in worded})
    assert kept.columns == docs.columns and kept.where("text = ''").count() == 40
