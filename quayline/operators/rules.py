"""Firewall-style rules over request logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.functions import constants as K
from quayline.functions.text import contains_any
from quayline.operators.running import rate_exceeded


@dataclass(frozen=True)
class Rule:
    """One blocking rule.  ``kind`` is ``contains`` (any of ``values`` occurs in
    the lower-cased column), ``in_list`` (the column is one of ``values``) or
    ``rate`` (more than ``limit`` rows per ``column`` in ``seconds``)."""

    name: str
    priority: int
    kind: str
    column: str
    values: tuple[str, ...] = ()
    limit: int = 0
    seconds: int = K.RATE_WINDOW_SECONDS
    action: str = "block"


def sample_rules(
    agent: str = "user_agent", country: str = "country", address: str = "client_ip", limit: int = K.RATE_LIMITS[0]
) -> list[Rule]:
    """The custom rules of the sample firewall."""
    return [
        Rule("rate-limit-per-ip", 80, "rate", address, limit=limit),
        Rule("geo-block", 90, "in_list", country, K.BLOCKED_COUNTRIES),
        Rule("block-suspicious-ua", 100, "contains", agent, K.SCANNER_AGENTS),
    ]


def evaluate_rules(logs: DataFrame, rules: Sequence[Rule], ts: str = "ts", default: str = "allow") -> DataFrame:
    """Add ``action`` and ``rule`` of the first matching rule by priority.

    Rows no rule matches get the default action and a NULL rule.  All list and
    text rules are one expression; only a rate rule needs a shuffle.
    """
    ordered = sorted(rules, key=lambda r: r.priority)
    rows, flags = logs, []
    hits: list[Column] = []  # by position: names may repeat
    for i, rule in enumerate(ordered):
        if rule.kind == "rate":
            flag = f"_rate_{i}"
            rows = rate_exceeded(rows, [rule.column], ts, rule.limit, rule.seconds, out=flag)
            flags.append(flag)
            hits.append(F.col(flag))
        elif rule.kind == "in_list":
            hits.append(F.coalesce(F.col(rule.column).isin(list(rule.values)), F.lit(False)))
        elif rule.kind == "contains":
            hits.append(contains_any(rule.column, rule.values))
        else:
            raise ValueError(f"unknown rule kind: {rule.kind}")
    if not ordered:
        return logs.withColumn("action", F.lit(default)).withColumn("rule", F.lit(None).cast("string"))
    action = name = None
    for rule, hit in zip(ordered, hits, strict=True):
        action = (F if action is None else action).when(hit, rule.action)
        name = (F if name is None else name).when(hit, rule.name)
    return rows.withColumn("action", action.otherwise(default)).withColumn("rule", name).drop(*flags)


def rule_summary(evaluated: DataFrame) -> DataFrame:
    """Hits per rule and action."""
    return evaluated.groupBy("rule", "action").agg(F.count("*").alias("hits"))
