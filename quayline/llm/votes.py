"""Weak supervision: heuristics vote, expectation-maximisation weighs their votes.

Each labeller votes good (1), bad (-1) or abstains (0).  A document's votes are one
pattern; there are at most 3^m patterns of m labellers however many documents there
are, so only the counts of patterns leave Spark.  The model is that every labeller has its
own rates of good, bad and no vote on good and on bad documents; expectation-
maximisation fits these accuracies and the share of good documents to the counts, and
every pattern gets a posterior probability of good quality.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 3^m patterns at most reach the driver.
MOST_LABELLERS = 10
ROUNDS = 200
START = 0.9
#: Pseudo-counts: a labeller is expected to be right rather than wrong.
EXPECTED = {"good": {"+": 2.0, "-": 0.1, "0": 2.0}, "bad": {"+": 0.5, "-": 2.0, "0": 2.0}}


def vote(good: Column, bad: Column) -> Column:
    """One letter: ``-`` if bad, else ``+`` if good, else ``0``; null conditions don't hold."""
    return F.when(F.coalesce(bad, F.lit(False)), "-").when(F.coalesce(good, F.lit(False)), "+").otherwise("0")


def pattern(votes: list[Column]) -> Column:
    if len(votes) > MOST_LABELLERS:
        raise ValueError(f"at most {MOST_LABELLERS} labellers")
    return F.concat(*votes)


def fit(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], list[dict[str, dict[str, float]]], float]:
    """Posterior of good per pattern, rates per labeller, and the share of good.

    ``rates[j]["good"]["+"]`` is how often labeller j votes ``+`` on good documents, and
    so on: its accuracy on either class.  The start is a plain majority of votes, so
    equal inputs give equal results.
    """
    if not counts:
        return {}, [], 1.0
    counts = dict(sorted(counts.items()))  # so that sums don't depend on the order of rows
    total, size = sum(counts.values()), len(next(iter(counts)))
    good = {p: START if p.count("+") > p.count("-") else 1 - START if "-" in p else 0.5 for p in counts}
    rates: list[dict[str, dict[str, float]]] = []
    share = 0.5
    for _ in range(rounds):
        share = (sum(n * good[p] for p, n in counts.items()) + 1) / (total + 2)
        rates = [{"good": dict(EXPECTED["good"]), "bad": dict(EXPECTED["bad"])} for _ in range(size)]
        for p, n in counts.items():
            for j, v in enumerate(p):
                rates[j]["good"][v] += n * good[p]
                rates[j]["bad"][v] += n * (1 - good[p])
        for r in rates:
            for kind in r:
                whole = sum(r[kind].values())
                r[kind] = {v: x / whole for v, x in r[kind].items()}
        odds_of = [{v: math.log(r["good"][v] / r["bad"][v]) for v in "+-0"} for r in rates]
        for odds in odds_of:  # a vote never counts for its opposite
            odds["-"], odds["+"] = min(odds["-"], 0.0), max(odds["+"], 0.0)
        new = {}
        for p in counts:
            odds = math.log(share / (1 - share)) + sum(odds_of[j][v] for j, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        moved = max(abs(new[p] - good[p]) for p in counts)
        good = new
        if moved < 1e-9:
            break
    return good, rates, share


def posterior(votes: DataFrame, column: str = "pattern") -> tuple[Column, list, float]:
    """Fit on all rows: an expression that gives a row its probability of good, the
    rates, the share of good."""
    counts = {r[column]: r["n"] for r in votes.groupBy(column).agg(F.count("*").alias("n")).collect()}
    good, rates, share = fit(counts)
    if not good:
        return F.lit(1.0), rates, share
    table = F.create_map(*[F.lit(x) for p in sorted(good) for x in (p, good[p])])
    return table[F.col(column)], rates, share
