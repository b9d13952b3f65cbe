"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule is ``host/path``: it fits its host and all subdomains if the URL's path starts
with the rule's path; the longest rule that fits decides.  URLs that some rule decides
are the labelled URLs.  Trees trained on them by their lexical features (length, depth,
digits, entropy, parameters, statistics of host suffixes) judge all others.

Features are built-in functions, the trees are Spark ML's.  The trees are fitted on at
most ``fit_rows`` distinct labelled URLs, half of each label, those with the least hashes,
weighted by their labels' shares; suffix statistics count all labelled URLs (for the rows
that are fitted, those of the other folds of URLs) and every URL is judged.

Cases: a null URL, or one without ``://``, has empty host and path, fits no rule with a
path and is judged by the trees; so does one with a host and an empty path.  Rules of equal length are taken in reverse order of
their text.  Without labelled URLs everything left is allowed; if all labels agree,
they decide the rest.  Repeated rows give repeated results.  URLs are taken whole, an
empty table gives no rows, and other columns, whatever their names, are neither read nor
returned.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.tables import read_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
FIT_ROWS = 20_000
#: Labelled URLs of a suffix count as if so many more had the average label.
PRIOR = 20.0
FOLDS = 5
FEATURES = (
    "url_length host_length path_length query_length depth labels params digit_ratio upper_ratio mark_ratio "
    "entropy longest_part host_digits path_digits extension suffix_rate suffix_seen"
).split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    kinds, texts = [F.lit(None).cast("string")], [F.lit(None).cast("string")]
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, tail = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{tail}"))
        kinds.insert(0, F.when(fits, F.lit(kind)))
        texts.insert(0, F.when(fits, F.lit(text)))
    return F.coalesce(*texts), F.coalesce(*kinds)


def removed(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL's own letters."""
    size = F.length(url).cast("double")
    share = lambda left: F.when(size > 0, 1 - F.length(left) / size).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def add(total: Column, letter: Column) -> Column:
        k = (F.length(url) - F.length(F.replace(url, letter))).cast("double")
        return total + k * F.log2(k)

    # Shannon entropy of the letters, in bits: log n - sum(k log k) / n.
    entropy = F.when(size > 0, F.log2(size) - F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda t, c: F.when(c == "", t).otherwise(add(t, c))) / size)
    digits = "0123456789"
    return {
        "url_length": size,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": (F.length(path) - F.length(removed(path, "/"))).cast("double"),
        "labels": (F.length(host) - F.length(removed(host, "."))).cast("double"),
        "params": F.when(query == "", 0.0).otherwise(1.0 + F.length(query) - F.length(removed(query, "&"))),
        "digit_ratio": share(removed(url, digits)),
        "upper_ratio": share(removed(url, UPPER)),
        "mark_ratio": share(removed(url, "-_~%=&+@:;,!$*'()")),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "longest_part": F.coalesce(F.array_max(F.transform(F.split(path, "/"), F.length)), F.lit(0)).cast("double"),
        "host_digits": (F.length(host) - F.length(removed(host, digits))).cast("double"),
        "path_digits": (F.length(path) - F.length(removed(path, digits))).cast("double"),
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1).isin("", "html", "htm", "php").cast("double"),
    }


def fit_sample(labelled: DataFrame, totals: dict[float, int], fit_rows: int) -> DataFrame:
    """Of each label's rows the ``fit_rows / 2`` with the least hashes of their URLs (all
    if there are no more), beside a ``weight`` that gives each label its share again."""
    each, parts = max(1, fit_rows // 2), []
    for label, n in totals.items():
        rows = labelled.where(F.col("blocked") == label).withColumn("place", F.xxhash64("url"))
        if n > each:
            # Hashes are spread evenly: about twice as many as are needed are sorted.
            share = (2 * each + 1000) / n
            rows = rows.where(F.col("place") < -(1 << 63) + int(share * (1 << 64))) if share < 1 else rows
            rows = rows.orderBy("place", "url").limit(each)
        parts.append(rows.drop("place").withColumn("weight", F.lit(n / min(n, each))))
    return parts[0].unionByName(parts[1])


def judge_urls(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", fit_rows: int = FIT_ROWS, trees: int = 12
) -> DataFrame:
    """Per row: the id column, ``host``, ``path``, ``rule``, ``verdict`` and
    ``block_score`` (the trees' probability; null where a rule decides)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), url.alias("url"))
    host, path = url_parts(F.col("url"))
    base = base.select("id", "url", host.alias("host"), path.alias("path"))
    rule, label = fitting_rule(F.col("host"), F.col("path"), rules)
    suffix = F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0)
    base = base.select("*", rule.alias("rule"), label.alias("label"), suffix.alias("suffix"))

    blocked = (F.col("label") == "block").cast("double")
    labelled = written(
        base.where("label is not null").groupBy("url", "host", "path", "suffix").agg(F.max(blocked).alias("blocked")), "url-labels"
    )
    total = labelled.agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).first()
    rate = total.b / total.n if total.n else 0.0
    if rate in (0.0, 1.0):
        verdict = F.coalesce("label", F.lit("block" if rate else "allow"))
        score = F.when(F.col("label").isNull(), F.lit(rate))
        return base.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), score.alias("block_score"))

    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))
    counts = F.sum("blocked").alias("b"), F.count("*").alias("n")
    per_fold = written(labelled.withColumn("fold", fold).groupBy("suffix", "fold").agg(*counts), "url-suffixes")
    per_suffix = per_fold.groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))

    def features(rows: DataFrame, held_out: bool = False) -> DataFrame:
        """Features of rows; if ``held_out``, rates come from URLs of other folds, so
        that no labelled row's own label is among them."""
        rows = rows.join(per_suffix, "suffix", "left").fillna({"b": 0.0, "n": 0})
        if held_out:
            own = per_fold.select("suffix", "fold", F.col("b").alias("own_b"), F.col("n").alias("own_n"))
            rows = rows.withColumn("fold", fold).join(own, ["suffix", "fold"], "left")
            rows = rows.withColumns({"b": F.col("b") - F.col("own_b"), "n": F.col("n") - F.col("own_n")})
        rows = rows.withColumns({"suffix_rate": (F.col("b") + PRIOR * rate) / (F.col("n") + PRIOR), "suffix_seen": F.log1p("n")})
        made = rows.select("*", *[c.alias(k) for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(made)

    sample = fit_sample(labelled, {0.0: total.n - int(total.b), 1.0: int(total.b)}, fit_rows)
    fit = written(features(sample, held_out=True).select("features", "blocked", "weight"), "url-fit")
    model = GBTClassifier(labelCol="blocked", weightCol="weight", maxIter=trees, maxDepth=4, maxBins=32, stepSize=0.3, seed=7).fit(fit)

    open_rows = F.col("label").isNull()
    judged = model.transform(features(base.where(open_rows)))
    score = vector_to_array("probability")[1]
    names = [F.col("id").alias(id_col), "host", "path", "rule"]
    by_trees = judged.select(
        *names, F.when(score > 0.5, "block").otherwise("allow").alias("verdict"), score.alias("block_score")
    )
    by_rules = base.where(~open_rows).select(*names, F.col("label").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    return by_rules.unionByName(by_trees)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))
