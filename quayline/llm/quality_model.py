"""Quality classifier from weak labels.

Overlapping heuristics look at every whole text and vote (``votes``: expectation-
maximisation estimates how reliable each is).  The posterior probabilities of a bounded
sample of texts train a linear scorer over hashed features: shapes of words, words, and
words that repeat the one before.  The scorer then judges every text, also where the
heuristics say little.

Vote patterns are counted over all texts.  ``fit_docs`` is the size of the sample (the
distinct texts of the least hashes, all if there are fewer), ``BINS`` bounds the
features, so fitting needs the same memory however many documents there are.

Cases: a text without words (null, empty, blank) is never good: score 0.  Repeated rows
get equal scores.  Texts are scored whole, in parts that end between words.  Without
rows nothing is fitted; if all weak labels agree, the scorer follows them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.hashing import LETTER, LOWER, SPACE, U, mix, pieces, range_hashes, text_bytes, word_borders
from quayline.llm.tables import map_batches, read_table, written
from quayline.llm.votes import fit as fit_votes

FIT_DOCS = 4_000
#: Hashed features; 64 KB of weights.
BINS = 1 << 14
STEPS = 300
RIDGE = 1e-4

# Kinds of bytes: lower-case and other letters, capitals, digits; marks are themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[0x61:0x7B] = KIND[0x80:] = ord("a")
KIND[0x41:0x5B] = ord("A")
KIND[0x30:0x3A] = ord("0")
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>~^{}[]\\_=+@"))
MARK = np.isin(np.arange(256), list(b"!?"))
INNER = (np.arange(256) & 0xC0) == 0x80  # bytes inside a character
LABELLERS = ("prose", "variety", "symbols", "marks", "capitals", "echo", "lines", "chant", "wordless")


def word_shapes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per word of its runs of byte kinds, a run of marks by its length up to 3."""
    kind = KIND[part]
    turn = np.ones(len(part), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    turn &= ~SPACE[part]
    at = np.flatnonzero(turn)
    if not len(at):
        return np.zeros(0, U)
    first = np.searchsorted(at, starts)
    last = np.append(first[1:], len(at))
    stop = np.append(at[1:], len(part))
    stop[last - 1] = ends
    length = np.where(np.isin(kind[at], list(b"aA0")), 1, np.minimum(stop - at, 3))
    return range_hashes(LETTER[kind[at]] * (length.astype(U) * U(2) + U(1)), first, last)


def word_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and the bins of all its features."""
    words, bins = [], []
    before = None
    for part in pieces(data):
        starts, ends = word_borders(part)
        if not len(starts):
            continue
        own = range_hashes(LETTER[LOWER[part]], starts, ends)
        shapes = word_shapes(part, starts, ends)
        same = own == np.concatenate([[before if before is not None else ~own[0]], own[:-1]])
        before = own[-1]
        words.append(own)
        bins += [mix(shapes) % U(BINS), mix(own + U(1)) % U(BINS), mix(shapes[same] + U(2)) % U(BINS), np.full(same.sum(), 1, U)]
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(bins).astype(np.int64)


def heuristic_votes(data: np.ndarray, words: np.ndarray) -> str:
    """One letter per labeller: ``+`` good, ``-`` bad, ``0`` no vote."""
    n = len(words)
    if not n:
        return "0" * (len(LABELLERS) - 1) + "-"
    chars = n and int((~(SPACE[data] | INNER[data])).sum())
    count = np.bincount(data, minlength=256)
    symbols, marks, capitals = int(count[SYMBOL].sum()), int(count[MARK].sum()), int(count[0x41:0x5B].sum())
    digits, stops = int(count[0x30:0x3A].sum()), int(count[0x2E])
    letters = 1 - (symbols + marks + digits) / chars
    unlike, times = np.unique(words, return_counts=True)
    echo = int((words[1:] == words[:-1]).sum())
    lines = [line for line in data.tobytes().split(b"\n") if line.strip()]
    some = n >= 20

    def vote(good: bool, bad: bool) -> str:
        return "-" if bad else "+" if good else "0"

    return "".join([
        vote(letters >= 0.97 and 0.01 <= stops / n <= 0.4, letters < 0.88),
        vote(len(unlike) / n > 0.35, some and len(unlike) / n < 0.1),
        vote(False, symbols > 0.2 * n),
        vote(False, marks > 0.3 * n),
        vote(False, capitals > 0.25 * chars),
        vote(False, some and echo > 0.2 * n),
        vote(False, len(lines) - len(set(lines)) > 0.3 * len(lines)),
        vote(False, some and int(times.max()) > 0.3 * n),
        "0",
    ])


def sparse(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins and their values, scaled to length one."""
    at, n = np.unique(bins, return_counts=True)
    return at.astype(np.int32), (n / np.sqrt((n.astype(float) ** 2).sum())).astype(np.float32) if len(n) else n.astype(np.float32)


def least_name(texts: DataFrame, fit_docs: int) -> int | None:
    """The greatest of the ``fit_docs`` least names (64-bit hashes) of distinct texts with
    words, by which that many texts are chosen however often each is repeated; None if
    there are no more than that."""
    named = texts.where(F.rlike("text", F.lit(r"[^\t-\r ]"))).select(F.xxhash64("text").alias("name"))
    names = written(named.distinct(), "text-names")
    total = names.count()
    if total <= fit_docs:
        return None
    # Names are spread evenly: below this one are about twice as many as are needed.
    some = names
    if total > 4 * fit_docs + 1000:
        some = names.where(F.col("name") < -(1 << 63) + int((2 * fit_docs + 1000) / total * (1 << 64)))
    return sorted(r.name for r in some.collect())[fit_docs - 1]


def weak_votes(docs: DataFrame, last: int | None) -> DataFrame:
    """pattern of every row of (text); of the texts named up to ``last`` (all if None)
    their name and features too, once in a task."""

    def make():
        seen: set[int] = set()

        def one(batch: pa.RecordBatch) -> dict:
            out = {"pattern": [], "name": [], "bins": [], "values": []}
            for name, data in zip(batch.column(1).to_pylist(), text_bytes(batch.column(0)), strict=True):
                words, bins = word_features(data)
                out["pattern"].append(heuristic_votes(data, words))
                chosen = len(words) > 0 and (last is None or name <= last) and name not in seen
                if chosen:
                    seen.add(name)
                at, values = sparse(bins) if chosen else (None, None)
                out["name"].append(name if chosen else None)
                out["bins"].append(at.tobytes() if chosen else None)
                out["values"].append(values.tobytes() if chosen else None)
            return out

        return one

    named = docs.select("text", F.xxhash64("text").alias("name"))
    return map_batches(named, ["text", "name"], "pattern string, name long, bins binary, values binary", make)


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer, by full-batch Adam steps."""
    weights = np.zeros(BINS + 1)
    if not rows:
        return weights
    sizes = np.array([len(r[0]) for r in rows])
    at, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    row, target = np.repeat(np.arange(len(rows)), sizes), np.array([r[2] for r in rows])
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, values * weights[at], len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / len(rows)
        slope = np.append(np.bincount(at, values * error[row], BINS), error.sum()) + RIDGE * np.append(weights[:-1], 0) / 10
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
    return weights


def train(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS) -> np.ndarray | None:
    """The scorer's weights, from weak labels of the documents; None without rows."""
    texts = docs.select(F.col(text_col).alias("text"))
    votes = written(weak_votes(texts, least_name(texts, fit_docs)), "weak-votes")
    counts = {r.pattern: r.n for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    good, _, _ = fit_votes(counts)
    # Each distinct text counts once, whichever tasks met it.
    sample = votes.where("name is not null").dropDuplicates(["name"]).collect()
    sample.sort(key=lambda r: r.name)
    return fit_linear([(np.frombuffer(r.bins, np.int32), np.frombuffer(r["values"], np.float32), good[r.pattern]) for r in sample])


def score_text(data: np.ndarray, weights: np.ndarray) -> float:
    """The probability that a text is good."""
    at, values = sparse(word_features(data)[1])
    if not len(at):
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(values @ weights[at] + weights[-1], -30, 30))))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, least: float = 0.5) -> DataFrame:
    """Per row the id column, ``score`` and ``kept`` (score of at least ``least``)."""
    weights = train(docs, text_col, fit_docs)
    weights = np.zeros(BINS + 1) if weights is None else weights

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            scores = [score_text(d, weights) for d in text_bytes(batch.column(1))]
            return {id_col: batch.column(0), "score": scores, "kept": [s >= least for s in scores]}

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, score double, kept boolean", make)


def keep_good(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS, least: float = 0.5) -> DataFrame:
    """The rows whose texts score at least ``least``; columns unchanged."""
    weights = train(docs, text_col, fit_docs)
    if weights is None:
        return docs

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([score_text(d, weights) >= least for d in text_bytes(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"))
