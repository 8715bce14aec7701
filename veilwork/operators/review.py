"""Review policy: which detections are masked, and how reviewers change that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import geometry as G
from veilwork.functions.text import kind_dimension
from veilwork.operators.detect import PAGE
from veilwork.sources.staging import written

#: Fixed value: a drawn box is this many pixels wide and high at least.
LEAST_DRAWN = 4.0

EDIT = "struct<edit_seq:long,op:string,handle:string,x1:double,y1:double,x2:double,y2:double>"


def default_enabled(detections: DataFrame) -> DataFrame:
    """All kinds are on at first, but for other codes."""
    kinds = kind_dimension(detections.sparkSession).select("kind", F.col("default_on").alias("enabled"))
    return detections.join(F.broadcast(kinds), "kind", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def apply_toggles(detections: DataFrame, toggles: DataFrame) -> DataFrame:
    """A toggle decides; a detection without one is off."""
    return detections.join(toggles.select(*PAGE, "detection_index", "enabled"), [*PAGE, "detection_index"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def toggle_table(detections: DataFrame, overrides: DataFrame) -> DataFrame:
    """The defaults with a reviewer's overrides: doc_id, page_index, detection_index, enabled."""
    key = [*PAGE, "detection_index"]
    own = default_enabled(detections).select(*key, "enabled")
    changed = overrides.select(*key, F.col("enabled").alias("override"))
    return own.join(changed, key, "left").select(*key, F.coalesce("override", "enabled").alias("enabled"))


def review_counts(reviewed: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: detections, enabled ones, pages and elapsed time; documents without detections too."""
    found = reviewed.groupBy("doc_id").agg(F.count("*").alias("total"), F.sum(F.col("enabled").cast("int")).alias("enabled"))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return size.join(found, "doc_id", "left").fillna(0, ["total", "enabled"])


def with_mask_bounds(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Add the box that is painted for each detection."""
    size = pages.select(*PAGE, "width", "height")
    return detections.join(size, PAGE).withColumn("mask", G.mask_bounds(F.col("kind"), F.col("mask_bbox"), F.col("width"), F.col("height"))).drop("width", "height")


def seed_boxes(reviewed: DataFrame, pages: DataFrame) -> DataFrame:
    """Enabled detections as boxes to edit: doc_id, page_index, box_id, box."""
    on = with_mask_bounds(reviewed.where("enabled"), pages)
    return on.select(*PAGE, F.concat(F.lit("auto-"), F.col("detection_index").cast("string")).alias("box_id"), F.col("mask").alias("box"))


def fold_box_edits(seeds: DataFrame, edits: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes after draw, move, resize and delete, in the order of edit_seq.

    draw takes corners x1, y1, x2, y2 and counts from 4 pixels each way; move shifts by x1, y1; resize leads the
    handle's edges to x1, y1. Edits of a box that is not there do nothing. Each box is folded on its own: its
    edits, bounded by what a reviewer does, are one short array.
    """
    key = [*PAGE, "box_id"]
    listed = edits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast(t).alias(c) for c, t in (x.split(":") for x in EDIT[7:-1].split(",")))))).alias("edits"))
    rows = listed.join(seeds.select(*key, "box"), key, "full_outer").join(pages.select(*PAGE, "width", "height"), PAGE)
    none = F.array().cast(f"array<{EDIT}>")
    folded = folded_box(F.col("box"), F.coalesce("edits", none), F.col("width"), F.col("height"))
    return rows.select(*key, folded.alias("box")).where(F.col("box").isNotNull())


def folded_box(seed: Column, edits: Column, width: Column, height: Column) -> Column:
    """A box, or null for none, after edits (an array of EDIT, in order) on a page of a size."""
    return F.aggregate(edits, seed.cast(G.BOX), _edit_step(width, height))


def last_box(seed: Column, edits: Column, width: Column, height: Column) -> Column:
    """As folded_box, but of a box that was deleted the last place that it had."""
    step, both = _edit_step(width, height), f"struct<box:{G.BOX},last:{G.BOX}>"

    def after(acc: Column, e: Column) -> Column:
        new = step(acc["box"], e).cast(G.BOX)
        return F.struct(new.alias("box"), F.coalesce(new, acc["last"]).alias("last")).cast(both)

    begin = F.struct(seed.cast(G.BOX).alias("box"), seed.cast(G.BOX).alias("last")).cast(both)
    return F.aggregate(edits, begin, after)["last"]


def _edit_step(width: Column, height: Column) -> Callable[[Column, Column], Column]:
    """The box after one edit."""
    w, h = width.cast("double"), height.cast("double")

    def step(b: Column, e: Column) -> Column:
        drawn = G.clamp_draw(G.normalize_box(e["x1"], e["y1"], e["x2"], e["y2"]), w, h)
        large = (F.abs(e["x2"] - e["x1"]) >= LEAST_DRAWN) & (F.abs(e["y2"] - e["y1"]) >= LEAST_DRAWN)
        moved = G.clamp_move(G.box(b["x"] + e["x1"], b["y"] + e["y1"], b["w"], b["h"]), w, h)
        sized = G.clamp_resize(G.resize_by_handle(b, e["handle"], e["x1"], e["y1"]), w, h)
        there = b.isNotNull()
        none = F.lit(None).cast(G.BOX)
        return (
            F.when((e["op"] == "draw") & large, drawn.cast(G.BOX)).when((e["op"] == "move") & there, moved.cast(G.BOX))
            .when((e["op"] == "resize") & there, sized.cast(G.BOX)).when(e["op"] == "delete", none).otherwise(b)
        )

    return step


def merge_handoff(sessions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming seeds into editing sessions: a clean session is overwritten, a dirty one waits for a decision.

    sessions: doc_id, dirty, boxes and optionally pending (boxes that wait already); incoming: doc_id, boxes and optionally
    resolution (keep or replace), which also decides on boxes that wait. Result: doc_id, dirty, boxes, pending (boxes that wait, or null).
    """
    if "resolution" not in incoming.columns:
        incoming = incoming.withColumn("resolution", F.lit(None).cast("string"))
    rows = sessions.withColumnRenamed("boxes", "own").join(incoming.withColumnRenamed("boxes", "new"), "doc_id", "full_outer")
    if "pending" in sessions.columns:
        rows = rows.withColumn("new", F.coalesce("new", "pending"))
    dirty = F.coalesce("dirty", F.lit(False))
    waits = dirty & F.col("new").isNotNull() & F.col("resolution").isNull()
    takes = F.col("new").isNotNull() & (~dirty | (F.col("resolution") == "replace"))
    return rows.select(
        "doc_id", F.when(F.coalesce(takes, F.lit(False)), F.lit(False)).otherwise(dirty).alias("dirty"),
        F.when(F.coalesce(takes, F.lit(False)), F.col("new")).otherwise(F.col("own")).alias("boxes"), F.when(waits, F.col("new")).alias("pending"),
    )


#: Partitions of a session table: an upsert rewrites those that incoming seeds fall in.
SESSION_PARTS = 64


def _session_part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")


def write_sessions(sessions: DataFrame, path: str, parts: int = SESSION_PARTS) -> None:
    """A session table: doc_id, dirty, boxes, pending, in partitions by a hash of doc_id."""
    rows = sessions if "pending" in sessions.columns else sessions.withColumn("pending", F.lit(None).cast(sessions.schema["boxes"].dataType))
    rows.select("doc_id", "dirty", "boxes", "pending", _session_part(parts)).repartition("part").write.partitionBy("part").parquet(path)


def upsert_handoff(path: str, incoming: DataFrame, parts: int = SESSION_PARTS) -> None:
    """merge_handoff into a session table: only partitions with incoming seeds are read and written anew, the files of the others stay.

    The same seeds once more change nothing. What is written is settled in the shared folder first, as its partitions are read from the
    table; a partition is replaced when all of it has been written.
    """
    spark = incoming.sparkSession
    seeds = written(incoming.withColumn("part", _session_part(parts)), "seeds")
    touched = [r["part"] for r in seeds.select("part").distinct().collect()]  # parts at most
    if not touched:
        return
    sessions = spark.read.parquet(path).where(F.col("part").isin(touched)).drop("part")
    merged = written(merge_handoff(sessions, seeds.drop("part")), "sessions").withColumn("part", _session_part(parts))
    merged.select("doc_id", "dirty", "boxes", "pending", "part").repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def uncertain_report(detections: DataFrame) -> DataFrame:
    """Suspicious detections without their value."""
    return detections.where("suspicious").select(*PAGE, "detection_index", "kind", "confidence")
