"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents.
All but the last return the columns of ``documents``.

quality     texts that the weakly supervised scorer rejects go
duplicates  of every group of texts linked by five-word Jaccard similarity of 0.8 or
            more the one of the least id stays
benchmark   texts that hold a passage of ten words of a benchmark item go; shorter items
            drop nothing (op6 reports them)
secrets     secrets are replaced by a mark, ``n_chars`` follows
tokens      BPE ids of every text, with digests of the ids and of what they decode to

Cases: null and blank texts go with the first stage; repeated rows leave one row behind;
columns that ``documents`` doesn't have are passed on up to the last stage.  An empty
table gives an empty result.  SQL can't express the stages (the first is a fitted
model), so tests compare each with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quayline.llm import bpe, decontaminate, jaccard, quality_model, secrets
from quayline.llm.tables import read_table, written

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), short_items=False)


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), keep_ids=True)


STAGES = [
    ("quality", quality),
    ("duplicates", duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_marks),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
