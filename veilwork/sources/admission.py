"""Admission of documents against size, type, page and pixel budgets, before anything is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwork.functions.text import trim

#: Budgets, accepted types and raster scales.
MAX_BYTES, MAX_PAGES, MAX_PAGE_PIXELS, MAX_DOCUMENT_PIXELS = 20 * 1024 * 1024, 10, 40_000_000, 80_000_000
TYPES = ("image/jpeg", "image/png", "image/webp", "application/pdf")
EXTENSIONS = r"(?i)\.(jpe?g|png|webp|pdf)\z"
SCALES = {"auto_pdf": 3.0, "manual_pdf": 2.0, "image": 1.0}
POINTS_PER_PIXEL = 0.75

#: What failure messages are told apart by, in this order: all patterns of one alternative must occur.
FAILURES = (
    ("undecodable_image", (("source image could not be decoded",), ("createImageBitmap",), ("InvalidStateError",))),
    ("locked_pdf", (("password", "pdf"), ("encrypted",))),
    ("broken_pdf", (("invalid pdf",), ("corrupt",), ("InvalidPDFException",))),
    ("too_large", (("too large",), ("exceeds",))),
)
OTHER_FAILURE = "unexpected"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, and of those in it, as a manifest: name and size from file metadata alone; contents are not read.

    Spark's readers leave out files without a byte, which hold no page anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("mime"), "size")


def admit_files(manifest: DataFrame) -> DataFrame:
    """Add admitted and reason: too large first, then an accepted type, or an extension where the type says nothing."""
    mime = F.coalesce("mime", F.lit(""))
    known = mime.isin(*TYPES) | (mime.isin("", "application/octet-stream") & F.coalesce(F.col("name").rlike(EXTENSIONS), F.lit(False)))
    reason = F.when(F.col("size") > MAX_BYTES, "too_large").when(~known, "unsupported_type")
    return manifest.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def route_kind(manifest: DataFrame) -> DataFrame:
    """Add kind: pdf by type or by the name's end, else image."""
    pdf = (F.coalesce("mime", F.lit("")) == "application/pdf") | F.coalesce(F.col("name").rlike(r"(?i)\.pdf\z"), F.lit(False))
    return manifest.withColumn("kind", F.when(pdf, "pdf").otherwise("image"))


def gate_pages(documents: DataFrame) -> DataFrame:
    """Documents with a whole number of pages from 1 to 10."""
    n = F.col("num_pages").cast("double")
    return documents.where((n == F.floor(n)) & n.between(1, MAX_PAGES))


def gate_pixels(pages: DataFrame, scale: float) -> DataFrame:
    """Per document, whether every page and the running total of pixels stay in budget."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    sound = F.coalesce((w > 0) & (h > 0) & ~F.isnan(w) & ~F.isnan(h) & (w < float("inf")) & (h < float("inf")), F.lit(False))
    pixels = F.when(sound, F.ceil(w * scale) * F.ceil(h * scale)).otherwise(0)
    total = F.sum("pixels").over(Window.partitionBy("doc_id").orderBy("page_index"))
    rows = pages.withColumns({"pixels": pixels, "sound": sound}).withColumn("running", total)
    bad = ~F.col("sound") | (F.col("pixels") > MAX_PAGE_PIXELS) | (F.col("running") > MAX_DOCUMENT_PIXELS)
    return rows.groupBy("doc_id").agg(F.sum("pixels").alias("pixels"), (~F.bool_or(bad)).alias("admitted"))


def page_geometry(pages: DataFrame, kind: Column, scale: float) -> DataFrame:
    """Add raster and point sizes: PDF pages are measured in points, images in pixels."""
    pdf = kind == "pdf"
    raster = lambda c: F.when(pdf, F.ceil(F.col(c) * scale)).otherwise(F.col(c)).cast("long")
    points = lambda c: F.when(pdf, F.col(c)).otherwise(F.col(c) * POINTS_PER_PIXEL).cast("double")
    return pages.withColumns({"raster_width": raster("width"), "raster_height": raster("height"), "width_pt": points("width"), "height_pt": points("height")})


def output_name(name: Column) -> Column:
    """The name without its last extension, a leading dot being none, with _redacted.pdf behind."""
    plain = F.coalesce(F.nullif(trim(name), F.lit("")), F.lit("document"))
    return F.concat(F.regexp_replace(plain, r"(?s)^(.+)\.[^.]*\z", "$1"), F.lit("_redacted.pdf"))


def classify_failure(message: Column, typed: Column | None = None) -> Column:
    """The first category with an alternative of which all patterns occur, whatever the case.

    Where typed is true, the failure is an input error whose message is written for users: it passes through as it is.
    """
    out = F.lit(OTHER_FAILURE)
    low = F.lower(F.coalesce(message, F.lit("")))
    for name, alternatives in reversed(FAILURES):
        hit = F.lit(False)
        for patterns in alternatives:
            own = F.lit(True)
            for p in patterns:
                own = own & low.contains(p.lower())
            hit = hit | own
        out = F.when(hit, name).otherwise(out)
    return out if typed is None else F.when(F.coalesce(typed, F.lit(False)), message).otherwise(out)
