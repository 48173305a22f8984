"""A corpus from raw documents: quality rules, toxicity, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``; the
last returns the training order. The first, second and fourth drop the
documents that they reject, the third all but the smallest doc_id of a group.

Rows are judged one by one, so repeated rows fare alike until the third stage
keeps one of each group. A row with a null or empty text fails the quality rules.
A null doc_id, lang, source or n_chars decides nothing and is passed on; in the
third stage null doc_ids stand behind all others, and in the last a null source is
a source of its own. Extra columns are passed on by all but the last stage,
whatever their names. An empty table gives empty stages.

Each stage sets the session's Arrow batches to ``ARROW_ROWS`` rows at most: texts may
be long, and the JVM and the Python worker of each task hold whole batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headway.llm import decontam, jaccard, mixing, quality, toxicity
from headway.llm.base import table, written

ARROW_ROWS = 1_000


def _short_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(setting, str(ARROW_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    _short_batches(spark)
    return jaccard.keep_first(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes: doc_id, source, size, copy, words and moment."""
    _short_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_a_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Hashing, learned scores and similarity joins are not SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
