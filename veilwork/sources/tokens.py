"""Tokens from recognition output, from free text and from a user's own recogniser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilwork.functions.text import BLANK, trim

OCR = "struct<lines:array<struct<words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>"

#: Width of a character, height of a line and confidence of tokens made from text.
CHARACTER, LINE, SURE = 10.0, 20.0, 0.95


def explode_ocr(results: DataFrame, column: str = "ocr_json") -> DataFrame:
    """Lines and words of recognition results, as JSON text or as a struct, to tokens; blank words are left out."""
    ocr = F.from_json(column, OCR) if isinstance(results.schema[column].dataType, T.StringType) else F.col(column)
    keys = [c for c in results.columns if c != column]
    lines = results.select(*keys, ocr.alias("ocr")).select(*keys, F.posexplode("ocr.lines").alias("line_id", "line"))
    words = lines.select(*keys, "line_id", F.posexplode("line.words").alias("token_seq", "word")).withColumn("text", trim(F.col("word.text"))).where(F.col("text") != "")
    b = lambda c: F.col(f"word.bbox.{c}")
    return words.select(*keys, "line_id", "token_seq", "text", b("x0").alias("x"), b("y0").alias("y"), (b("x1") - b("x0")).alias("w"), (b("y1") - b("y0")).alias("h"), (F.col("word.confidence") / 100).alias("confidence"))


def tokenize_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Free text to tokens: lines, words between white space, boxes by character offset. Each line is cut on its own."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_id", "line"))
    words = lines.select("doc_id", "line_id", F.posexplode(F.split("line", BLANK)).alias("part", "text"))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "line_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("offset", F.coalesce(before, F.lit(0))).where(F.col("text") != "")
    return words.select(
        "doc_id", F.lit(0).cast("long").alias("page_index"), "line_id", F.col("part").alias("token_seq"), "text",
        (F.col("offset") * CHARACTER).alias("x"), (F.col("line_id") * (LINE + 10)).cast("double").alias("y"),
        (F.length("text") * CHARACTER).alias("w"), F.lit(LINE).alias("h"), F.lit(SURE).alias("confidence"),
    )


def with_recognizer(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, attempts: int = 2) -> DataFrame:
    """Rows from a user's recogniser: load() runs once in each task, what it returns takes and gives batches.

    A start that fails is tried again, `attempts` times in all, before the task fails. Where what load() returns has a method close, it is
    called when the task ends, however it ends. Tasks without rows start none.
    """

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        for left in reversed(range(attempts)):
            try:
                return load()
            except Exception:
                if not left:
                    raise
        raise ValueError("a recogniser needs one attempt at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = None
        try:
            for batch in batches:
                if len(batch):
                    recognise = recognise or start()
                    yield recognise(batch)
        finally:
            if close := getattr(recognise, "close", None):
                close()

    return df.mapInPandas(run, schema)
