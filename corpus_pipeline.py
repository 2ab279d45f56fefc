"""The corpus pipeline: stages applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's documents.  All but the last return the columns of documents, with ``text`` and ``n_chars`` as
the stage leaves them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from deckwright.llm import bpe, common, decontaminate, jaccard, queries, suffix_dedup, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of texts that go to Python at once.  A batch is one block on either side, outside the heap, and a worker cuts it
#: to smaller steps anyway; with Spark's 10,000 rows a task holds tens of megabytes twice.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Stage) -> Stage:
    """The setting counts when the plan runs, so it stays in the session; a smaller one is left as it is."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic at 0.5 or more go."""
    source = common.table(spark, sf_dir, "documents")  # labels are of the documents as they came
    return toxicity.keep_clean(docs, toxicity.fit(source, common.table(spark, sf_dir, "labels")))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class stays: shingles of five words, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.Rule())


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 50 that an earlier document has go, and documents of which nothing is left."""
    return suffix_dedup.remove(docs)


@in_small_batches
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of ten that a benchmark item has go."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and decoded text."""
    return bpe.tokens(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", cut_benchmark),
    ("bpe_encoding", encode),
]
#: SQL can express neither the trained stage nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = queries.shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
