"""Assembled results and the manifest of masks to paint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.operators.detect import PAGE
from veilwork.operators.review import with_mask_bounds


def assemble_document(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document: kind, total elapsed time, and its pages in order with sizes and numbers of detections.

    A document has at most ten pages, so its page list is bounded.
    """
    found = detections.groupBy(*PAGE).agg(F.count("*").alias("detections"))
    rows = pages.join(found, PAGE, "left").fillna(0, ["detections"])
    page = F.struct("page_index", "width", "height", "width_pt", "height_pt", "detections")
    return rows.groupBy("doc_id").agg(F.first("kind").alias("kind"), F.sum("elapsed_ms").alias("elapsed_ms"), F.array_sort(F.collect_list(page)).alias("pages"))


def export_manifest(reviewed: DataFrame, manual: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: point size and its mask boxes, automatic ones in detection order, then manual ones by id.

    Pages without mask appear with an empty list.
    """
    auto = with_mask_bounds(reviewed.where("enabled"), pages).select(*PAGE, F.lit(0).alias("source"), F.lpad(F.col("detection_index").cast("string"), 9, "0").alias("place"), F.col("mask").alias("box"))
    every = auto.unionByName(manual.select(*PAGE, F.lit(1).alias("source"), F.col("box_id").alias("place"), "box"))
    boxes = every.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "place", "box"))), lambda m: m["box"]).alias("masks"))
    rows = pages.select(*PAGE, "kind", "width_pt", "height_pt").join(boxes, PAGE, "left")
    return rows.withColumn("masks", F.coalesce("masks", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest in partitions by kind, so that who reads one kind opens its files only; written again, it replaces what was there."""
    manifest.write.mode("overwrite").partitionBy("kind").parquet(path)
