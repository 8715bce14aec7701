"""Corpus preparation from raw documents to text that went through the tokenizer, as five stages in a row.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps. All but the last return the columns
of documents; run() writes each result as Parquet in the shared folder and reads it as the next one's docs.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, further columns of any name, and an empty
table, which stays empty. What each does with them is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import bpe, decontaminate, exact_dedup, minhash, quality
from veilwork.llm.queries import table, tokenizer_path
from veilwork.llm.shared import staged


#: Texts that a Python worker gets at once; whole documents are long, and 10,000 of them too much beside the JVM.
BATCH_ROWS = 2_000


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose workers get BATCH_ROWS rows at once; what is computed does not depend on it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that more likely than not are bad or toxic.

    A null or empty text is judged by the thresholds alone; equal texts share their fate, whatever their ids; texts count whole.
    """
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.select(docs, model, wanted=2)


@small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the smallest doc_id.

    Null counts as an empty text, so one row without text stays. Rows without id all stay; of rows that share id and text one stays,
    rows that share an id only are told apart.
    """
    return exact_dedup.exact_dedup(docs)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by shingles of five words, keep the smallest doc_id.

    A text without words is like no other and stays, as do rows without id; fewer than five words are one shingle. Rows are told
    apart by themselves, so that one that shares its id with another loses no text.
    """
    return minhash.near_dedup(docs)


@small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of ten benchmark words occurs.

    Null and empty texts have no words and stay; repeated rows share their fate; without benchmark items all stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text, and keep how many tokens it has and whether they decode to it again.

    Null counts as an empty text, which has no tokens; each row, repeated or not, has a row of its own.
    """
    both = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path("byte_bpe_50k.json"))
    return both.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("bpe_encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
