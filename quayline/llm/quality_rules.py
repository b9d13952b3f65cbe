"""Quality rules that vote instead of all having to pass.

Statistics of every whole text are built-in functions over arrays, without Python and
without a shuffle.  Rules on them vote or abstain; ``votes`` estimates how reliable
each rule is and gives every document a probability of good quality, which replaces
all-must-pass filtering.  Only two plain bounds stay absolute (``base_failed``).

Repeated windows are found by sorting a text's window hashes (64 bits, compared within
one text only), n log n in the text's length.

Cases: a null text has no words.  Empty texts fail the base.  Repeated rows are judged
alike.  Without rows there is nothing to fit and nothing to return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.tables import read_table, written
from quayline.llm.votes import pattern, posterior, vote

# Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_of(text: Column, letters: str) -> Column:
    """How many characters of a text are among ``letters``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, and only where the result is needed."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def same(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
        step = lambda s, i: F.struct((s["total"] + F.least(F.lit(WINDOW), i - s["last"])).alias("total"), i.alias("last"))
        return F.aggregate(let(placed, same), start, step, lambda s: s["total"])

    any_twice = lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(0)
    return F.when(n < WINDOW, 0).otherwise(let(hashes(words), any_twice)).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document row; other columns are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", "text", F.array_remove(F.split("text", SPACE), "").alias("words")
    )
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    counted = words.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("unlike"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count_of(F.col("text"), UPPER).alias("n_upper"),
        count_of(F.col("text"), "!?").alias("n_marks"),
        count_of(F.col("text"), "0123456789").alias("n_digits"),
        count_of(F.col("text"), ".").alias("n_stops"),
    )
    return counted.select(
        F.col("id").alias(id_col),
        *[c for c in counted.columns if c not in ("id", "lines")],
        F.col("lines.all").cast("long").alias("n_lines"),
        (F.col("lines.all") - F.col("lines.unlike")).cast("long").alias("n_dup_lines"),
    )


def rules() -> list[Column]:
    """Votes on the statistics.  Most rules know one kind of junk and are silent about
    everything else; the first two also vote for good, with room to abstain between."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    per_word = lambda c: F.col(c) / words
    length = F.col("word_chars") / words
    letters = 1 - (F.col("n_symbols") + F.col("n_marks") + F.col("n_digits")) / chars
    some, never = F.col("n_words") >= 20, F.lit(False)
    return [
        vote((letters >= 0.97) & per_word("n_stops").between(0.01, 0.4), letters < 0.88),
        vote(per_word("n_distinct") > 0.35, some & (per_word("n_distinct") < 0.1)),
        vote(never, per_word("n_symbols") > 0.2),
        vote(never, per_word("n_marks") > 0.3),
        vote(never, F.col("n_upper") / chars > 0.25),
        vote(never, (length < 2.0) | (length > 14.0)),
        vote(never, per_word("n_repeat_words") > 0.3),
        vote(never, F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        vote(never, some & ((F.col("n_stops") == 0) | (per_word("n_stops") > 1.0))),
        vote(never, F.col("n_digits") / chars > 0.3),
    ]


def judge(statistics: DataFrame, least: float = 0.5) -> DataFrame:
    """All statistics with ``base_failed``, ``good`` (posterior) and ``kept``."""
    votes = statistics.withColumn("pattern", pattern(rules()))
    good, _, _ = posterior(votes)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return (
        votes.withColumn("base_failed", failed)
        .withColumn("good", good)
        .withColumn("kept", ~F.col("base_failed") & (F.col("good") >= least))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = written(text_statistics(read_table(spark, sf_dir, "documents")), "quality-statistics")
    return judge(statistics).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good"
    )
