"""Language identification by multilingual mixtures.

Each language is a table of log probabilities of hashed byte n-grams, learned from
labelled texts.  A text is a mixture of languages: expectation-maximisation over its
words, each with a likelihood under every language, estimates the proportions.  The
set of languages is grown from the most likely one while the likelihood gains more
than a penalty per language; the prediction is the largest share of the chosen set.

About ``fit_docs`` distinct texts per language are learned from, all if there are fewer,
chosen by a hash of the text and counted once each; all texts are predicted whole.

Cases: texts that are null or have no letter are ``und`` with score 0; so is everything
if there is nothing to learn from.  Labels that are null teach nothing.  Equal shares
go to the language that is first by name.  Repeated rows get equal results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.hashing import pieces, text_bytes
from quayline.llm.tables import map_batches, read_table

FIT_DOCS = 3_000
GRAM = 3
BINS = 1 << 16
ROUNDS = 12
#: What one more language must gain, times the logarithm of the number of words.
PENALTY = 3.0
#: Words' worth of belief in the languages' shares among the labelled texts.
PRIOR = 0.5

# ASCII letters in lower case, everything else of ASCII a space; other bytes as they are.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def grams(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every n-gram of the words of a text, each word with a space around
    it, and where each word's n-grams begin."""
    letters = np.full(len(part) + 2, 0x20, np.uint8)
    letters[1:-1] = LETTERS[part]
    code = letters.astype(np.uint32)
    run = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    inside = letters[1:-1] != 0x20  # the middle letter belongs to a word
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = ((run[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return bins, starts


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, bin, n over (lang, text)."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            counts: dict[str, np.ndarray] = {}
            for lang, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                table = counts.setdefault(lang, np.zeros(BINS, np.int64))
                for part in pieces(data):
                    table += np.bincount(grams(part)[0], minlength=BINS)
            out = {"lang": [], "bin": [], "n": []}
            for lang, table in counts.items():
                at = np.flatnonzero(table)
                out["lang"] += [lang] * len(at)
                out["bin"] += at.tolist()
                out["n"] += table[at].tolist()
            return out

        return one

    return map_batches(docs, ["lang", "text"], "lang string, bin int, n long", make).groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, log probabilities (languages x bins) and shares, from (lang, text)."""
    known = labelled.where("lang is not null and text is not null")
    known = known.select("lang", "text", F.xxhash64("text").alias("_name"))
    texts = known.groupBy("lang", "_name").agg(F.count("*").alias("n"))
    found = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("unlike")).collect()
    sizes, unlike = {r.lang: r.n for r in found}, {r.lang: r.unlike for r in found}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, BINS), np.float32), np.zeros(0)
    part = F.create_map(*[F.lit(x) for lang in names for x in (lang, min(1.0, fit_docs / unlike[lang]))])
    chosen = known.where(F.pmod("_name", F.lit(1_000_000)) < 1_000_000 * part[F.col("lang")])
    # Copies of a text are chosen all or none: each distinct one teaches once.
    chosen = chosen.dropDuplicates(["lang", "_name"])
    counts = np.zeros((len(names), BINS))
    found = count_grams(chosen.select("lang", "text")).toArrow()
    place = {lang: k for k, lang in enumerate(names)}
    row = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
    counts[row, found["bin"].to_numpy()] = found["n"].to_numpy()
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    smooth = 0.5
    logs = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * seen))
    shares = np.array([sizes[lang] for lang in names], float)
    return names, logs.astype(np.float32), shares / shares.sum()


def word_likelihoods(data: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log likelihood of every word under every language."""
    out = []
    for part in pieces(data):
        bins, starts = grams(part)
        if len(bins):
            out.append(np.stack([np.add.reduceat(table[bins], starts) for table in logs], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(logs)), np.float32)


def mixture(likelihoods: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood they reach."""
    best = likelihoods.max(axis=1, keepdims=True)
    odds = np.exp(likelihoods - best)
    prior = prior / prior.sum()
    shares = prior
    for _ in range(ROUNDS):
        each = odds * shares
        each /= each.sum(axis=1, keepdims=True)
        shares = (each.sum(axis=0) + PRIOR * prior) / (len(odds) + PRIOR)
    return shares, float((np.log(odds @ shares) + best[:, 0]).sum())


def language_shares(likelihoods: np.ndarray, prior: np.ndarray) -> dict[int, float]:
    """The chosen languages and their proportions."""
    shares, _ = mixture(likelihoods, prior)
    order = np.argsort(-shares, kind="stable")
    totals = likelihoods.sum(axis=0)
    first = int(np.argmax(totals + np.log(prior)))
    order = [first, *[int(k) for k in order if k != first]]
    chosen, level = [first], float(totals[first])
    found = {first: 1.0}
    for k in order[1:]:
        shares, reached = mixture(likelihoods[:, chosen + [k]], prior[chosen + [k]])
        if reached - level <= PENALTY * np.log(len(likelihoods) + 1):
            break
        chosen, level = chosen + [k], reached
        found = dict(zip(chosen, shares.tolist(), strict=True))
    return found


@lru_cache(maxsize=4096)
def is_letter(c: str) -> bool:
    return c.isalpha()


def has_letter(data: np.ndarray) -> bool:
    letters = LETTERS[data]
    if ((letters >= 0x61) & (letters <= 0x7A)).any():
        return True
    return any(map(is_letter, set(data.tobytes().decode("utf-8", "replace")))) if (data >= 0x80).any() else False


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row the id column, ``lang_pred``, ``score`` (its share) and ``languages``
    (all chosen ones with their shares).  ``labelled`` has columns lang and text."""
    names, logs, prior = learn(labelled, fit_docs)

    def predict(data: np.ndarray) -> tuple[str, float, list[dict]]:
        if not names or not has_letter(data):
            return "und", 0.0, []
        found = language_shares(word_likelihoods(data, logs), prior)
        top = min(found, key=lambda k: (-found[k], names[k]))
        return names[top], min(1.0, found[top]), [{"lang": names[k], "share": s} for k, s in sorted(found.items())]

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            made = [predict(d) for d in text_bytes(batch.column(1))]
            return {
                id_col: batch.column(0), "lang_pred": [m[0] for m in made], "score": [m[1] for m in made],
                "languages": [m[2] for m in made],
            }

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return map_batches(docs, [id_col, text_col], schema, make)


def remainder(column: Column, by: int) -> Column:
    return F.crc32(column.cast("string")) % by


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labelled = docs.where(remainder(F.col("doc_id"), 4) != 2).select("lang", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, labelled).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")
