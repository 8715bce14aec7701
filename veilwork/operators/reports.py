"""Counts and audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwork.functions.checksum import change_counts, verhoeff_valid
from veilwork.functions.text import KINDS
from veilwork.sources.staging import written

NAMES = [k[0] for k in KINDS]
HEADER = (("aadhaar", ("aadhaar",)), ("pan", ("pan",)), ("face", ("face",)), ("qr", ("uidai_qr", "other_qr")), ("mrz", ("passport_mrz",)))


def accuracy_by_sample(detections: DataFrame, samples: DataFrame) -> DataFrame:
    """Per sample (doc_id, elapsed_ms, error): the number of each kind, and error, hit or miss."""
    counts = detections.groupBy("doc_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in NAMES))
    rows = samples.join(counts, "doc_id", "left").fillna(0, NAMES)
    total = sum((F.col(k) for k in NAMES[1:]), F.col(NAMES[0]))
    status = F.when(F.col("error").isNotNull(), "error").when(total > 0, "hit").otherwise("miss")
    return rows.select("doc_id", *NAMES, status.alias("status"), "elapsed_ms")


def accuracy_totals(by_sample: DataFrame) -> DataFrame:
    """One row: samples, hits, misses, errors, recall, and the total of each kind."""
    tally = [F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("hit", "hits"), ("miss", "misses"), ("error", "errors"))]
    recall = (F.count(F.when(F.col("status") == "hit", 1)) / F.count("*")).alias("recall")
    return by_sample.agg(F.count("*").alias("samples"), *tally, recall, *(F.sum(k).alias(k) for k in NAMES))


def regression_log(detections: DataFrame, documents: DataFrame) -> DataFrame:
    """Samples by anonymous id: pages, detections and uncertain ones.

    documents: name, doc_id, num_pages. Numbers follow the names' order: names are ranked within ranges, and the
    ranges' sizes, one small row for each shuffle partition, are added up and broadcast, so no task sorts all names.
    """
    # Written once with the range that each row fell in: ranges are sampled, and a second sample may cut elsewhere.
    ranged = documents.repartitionByRange("name", "doc_id").withColumn("_part", F.spark_partition_id())
    parts = written(ranged, "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_ahead")
    parts = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy("name", "doc_id")))
    numbered = parts.join(F.broadcast(ahead), "_part").withColumn("_no", (F.col("_in") + F.col("_ahead")).cast("string"))
    sample = F.concat(F.lit("sample-"), F.lpad("_no", 3, "0"))
    sample = F.when(F.length("_no") > 3, F.concat(F.lit("sample-"), F.col("_no"))).otherwise(sample)
    found = detections.groupBy("doc_id").agg(F.count("*").alias("detections"), F.count(F.when(F.col("suspicious"), 1)).alias("uncertain"))
    return numbered.join(found, "doc_id", "left").fillna(0, ["detections", "uncertain"]).select(sample.alias("sample"), "num_pages", "detections", "uncertain")


def detection_header(detections: DataFrame) -> DataFrame:
    """aadhaar=1,pan=0,face=1,qr=1,mrz=0 per document."""
    counts = [F.count(F.when(F.col("kind").isin(*kinds), 1)).cast("string") for _, kinds in HEADER]
    text = F.concat_ws(",", *(F.concat(F.lit(f"{n}="), c) for (n, _), c in zip(HEADER, counts, strict=True)))
    return detections.groupBy("doc_id").agg(text.alias("header"))


def checksum_audit(ids: DataFrame, column: str = "id") -> DataFrame:
    """Of every change of one digit and every swap of two different neighbours in valid ids: how many, how many detected.

    The fold of a changed text is that of the digits behind the change, the changed ones and those before it, multiplied: the texts are not made.
    """
    names = ("substitution", "swap")
    valid = ids.select(F.col(column).alias("id")).where(verhoeff_valid("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tried = change_counts(b.column("id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n for n, _ in tried], pa.int64()), pa.array([n for _, n in tried], pa.int64())], ["error", "errors", "detected"])

    tested = valid.mapInArrow(run, "error string, errors long, detected long").where("errors > 0")
    return tested.groupBy("error").agg(F.sum("errors").alias("errors"), F.sum("detected").alias("detected"))


def random_pass_rate(ids: DataFrame, column: str = "id") -> DataFrame:
    """How many texts there are, and how many pass the checksum."""
    return ids.select(verhoeff_valid(column).alias("ok")).agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("passed"))
