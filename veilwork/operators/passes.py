"""Reconciling several recognition passes of a page."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwork.functions import geometry as G
from veilwork.functions.text import TEXT_KINDS
from veilwork.operators.detect import PAGE, detect_id12_inline, detect_id12_triplets, detect_pan, detect_text, detect_text_steps, greedy, merge_id12
from veilwork.sources.staging import written
from veilwork.sources.tokens import with_recognizer

#: Rotations in the order of trial, and the bands of a page's height with their order.
ROTATIONS = (180, 90, 270)
BANDS = ((0.3, 0.7), (0.0, 0.5), (0.5, 1.0))
#: Fixed value: line ids of a band begin so far behind those before.
LINE_STEP = 1000


def _is_text() -> Column:
    return F.col("kind").isin(*TEXT_KINDS)


def dealt(rows: DataFrame) -> DataFrame:
    """rows, for a join by shuffle whatever Spark takes their size for: columns of pages are written in two bytes or so a row, so
    tables of millions of rows pass for small and would go through the driver as a broadcast, at a hundred bytes and more a row."""
    return rows.hint("merge")


def pick_enhanced(raw: DataFrame, enhanced: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Where an image has no text hit, the enhanced pass's text hits; faces and codes always from the raw pass.

    pages: PAGE and kind; pages of another kind than image keep the raw pass. Without it, all are images.
    """
    hit = dealt(raw.where(_is_text()).select(*PAGE).distinct())
    new = enhanced.where(_is_text()).join(hit, PAGE, "left_anti")
    if pages is not None:
        new = new.join(dealt(pages.where(F.col("kind") == "image").select(*PAGE)), PAGE, "left_semi")
    return raw.unionByName(new)


def probe_rotation(probe_tokens: DataFrame) -> DataFrame:
    """The rotation of each page with most ids and tax ids, one at least; ties go to 180, then 90, then 270.

    probe_tokens has a column rotation beside those of tokens.
    """
    # Each rotation counts as a page of its own.
    page = F.col("page_index") * 1000 + F.col("rotation")
    rows = probe_tokens.where(F.col("rotation").isin(*ROTATIONS)).withColumn("page_index", page)
    hits = merge_id12(detect_id12_triplets(rows), detect_id12_inline(rows)).select(*PAGE).unionByName(detect_pan(rows).select(*PAGE))
    scores = hits.groupBy("doc_id", F.floor(F.col("page_index") / 1000).cast("long").alias("page_index"), F.pmod("page_index", F.lit(1000)).cast("int").alias("rotation")).agg(F.count("*").alias("score"))
    order = F.array_position(F.array(*(F.lit(r) for r in ROTATIONS)), F.col("rotation"))
    best = Window.partitionBy(*PAGE).orderBy(F.desc("score"), order)
    return scores.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")


def apply_rotation(detections: DataFrame, winners: DataFrame, rotated: DataFrame) -> DataFrame:
    """Pages without text hit that have a winner get all detections of that rotation's run instead.

    rotated: detections with a column rotation.
    """
    hit = dealt(detections.where(_is_text()).select(*PAGE).distinct())
    turned = dealt(winners.select(*PAGE, "rotation").join(hit, PAGE, "left_anti"))
    new = rotated.join(turned, [*PAGE, "rotation"], "left_semi").drop("rotation")
    return detections.join(turned, PAGE, "left_anti").unionByName(new)


def band_plan(pages: DataFrame) -> DataFrame:
    """Rows y0 to y1 of each page's bands, empty bands left out."""
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(BANDS)))
    rows = pages.select(*PAGE, "height", F.inline(bands))
    y0, y1 = F.greatest(F.lit(0), F.floor(F.col("height") * F.col("a"))), F.least(F.col("height"), F.ceil(F.col("height") * F.col("b")))
    return rows.select(*PAGE, "band", y0.cast("long").alias("y0"), y1.cast("long").alias("y1")).where(F.col("y1") > F.col("y0"))


def translate_band_tokens(band_tokens: DataFrame, plan: DataFrame, full: DataFrame) -> DataFrame:
    """Band tokens in page coordinates, their line ids behind those of the full page and of earlier bands."""
    last = full.groupBy(*PAGE).agg(F.max("line_id").alias("last"))
    # A row for each page, so that tokens are dealt by page alone and once.
    starts = plan.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("band").alias("of"), F.col("y0").alias("start"))).alias("starts"))
    rows = band_tokens.join(dealt(starts), PAGE).join(dealt(last), PAGE, "left")
    rows = rows.withColumn("own", F.explode(F.filter("starts", lambda s: s["of"] == F.col("band"))))
    base = F.coalesce("last", F.lit(-1)) + LINE_STEP * (F.col("band") + 1)
    return rows.withColumns({"y": F.col("y") + F.col("own.start"), "line_id": F.col("line_id") + base}).drop("last", "starts", "own")


def _flagged(current: DataFrame) -> DataFrame:
    """Per page: whether it has ids, and whether one of them is suspicious."""
    ids = F.col("kind") == "aadhaar"
    return current.groupBy(*PAGE).agg(F.coalesce(F.bool_or(ids), F.lit(False)).alias("has_id"), F.coalesce(F.bool_or(ids & F.col("suspicious")), F.lit(False)).alias("doubt"))


def settle_ids(ids: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Ids of each key without the suspicious ones that overlap a clean one of the same value, and, of those of the same value
    that overlap, the first in order."""
    overlap = lambda a, b: G.boxes_overlap(a["bbox"], b["bbox"])
    return greedy(ids, [*keys, "value"], order, overlap, lambda one, other: ~one["suspicious"] & other["suspicious"] & overlap(one, other))


def _with_tangled(read: DataFrame) -> DataFrame:
    """Add whether, on the row's page, a line of a band does not lie behind all lines of the full page (band -1) and of earlier bands."""
    page = Window.partitionBy(*PAGE)
    of = lambda i: F.when(F.col("band") == i, F.col("line_id"))
    bands = range(-1, len(BANDS))
    ends = {f"_{name}{i}": f(of(i)).over(page) for i in bands for name, f in (("first", F.min), ("last", F.max))}
    mixed = F.col("_unknown") > 0
    for i in bands[1:]:
        for j in range(-1, i):
            mixed = mixed | F.coalesce(F.col(f"_first{i}") <= F.col(f"_last{j}"), F.lit(False))
    rows = read.withColumns({**ends, "_unknown": F.count(F.when(F.col("line_id").isNull(), 1)).over(page)})
    return rows.withColumn("tangled", mixed).drop(*ends, "_unknown")


def recover_from_bands(full: DataFrame, bands: DataFrame, current: DataFrame, pages: DataFrame) -> DataFrame:
    """Text hits of the page with its first bands, for pages without an id or with a suspicious one.

    Steps add one band each; of the steps that have an id the last counts, but the first that covers
    every suspicious id of the page by a clean one of the same value ends the search. The ids of a step are settled among
    themselves. bands: translated band tokens with their band.
    """
    need = pages.select(*PAGE).distinct().join(dealt(_flagged(current)), PAGE, "left").where(~F.coalesce("has_id", F.lit(False)) | F.coalesce("doubt", F.lit(False))).select(*PAGE)
    n = len(BANDS)
    read = full.select(*TOKEN, F.lit(-1).alias("band")).unionByName(bands.select(*TOKEN, F.col("band").cast("int").alias("band")))
    # Dealt by page once, for what is needed, for tangled lines and for detection. No semi-join: Spark would move it into the union, and trust
    # that the parts of a union are dealt alike, which gave wrong rows.
    read = _with_tangled(read.join(dealt(need), PAGE))
    # Where lines of a band lie among those of another, each step is read on its own; else a hit is found once and lives from its last band on.
    born = F.greatest("band", F.lit(0))
    read = read.withColumn("_only", F.explode(F.when(F.col("tangled"), F.sequence(born, F.lit(n - 1))).otherwise(F.array(F.lit(None).cast("int")))))
    read = read.withColumn("_born", F.coalesce("_only", born)).drop("band", "tangled")

    # Read twice below: written, so that detection is planned and run once.
    hits = written(detect_text_steps(read, n), "steps")
    is_id = F.col("kind") == "aadhaar"
    mark = lambda rows, step: rows.select(*PAGE, F.struct(step.alias("step"), "value", "bbox", "suspicious").alias("mark"))
    marks = mark(hits.where(is_id), F.col("step")).unionByName(mark(current.where(is_id & F.col("suspicious")), F.lit(-1)))
    # Ids of a page are bounded by what it can show.
    marks = marks.groupBy(*PAGE).agg(F.collect_list("mark").alias("marks")).select(*PAGE, F.filter("marks", lambda m: m["step"] >= 0).alias("ids"), F.filter("marks", lambda m: m["step"] < 0).alias("doubts"))
    covers = lambda step, d: F.exists("ids", lambda i: (i["step"] == step) & ~i["suspicious"] & (i["value"] == d["value"]) & G.boxes_overlap(d["bbox"], i["bbox"]))
    done = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: (F.size("doubts") > 0) & F.forall("doubts", lambda d: covers(s, d)))
    chosen = marks.select(*PAGE, F.coalesce(F.array_min(done), F.array_max(F.transform("ids", lambda i: i["step"]))).alias("chosen"))
    return hits.join(dealt(chosen), PAGE).where(F.col("step") == F.col("chosen")).select(hits.columns).drop("step")


def merge_recovery(current: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered hits into a page's detections.

    A page without id gets the recovered text hits for all its own. Else only recovered ids are added,
    suspicious ids that overlap a clean one of the same value go, and of overlapping ids of the same value
    the first in the order of detection stays, those of the page before recovered ones. That order is detection_index, or
    part and place, where the rows have them, and else from top to bottom.
    """
    columns = [c for c in current.columns if c in recovered.columns]
    is_id, late = F.col("kind") == "aadhaar", F.col("_order.late") == 1

    def ordered(rows: DataFrame, late: int) -> DataFrame:
        """Rows with their place in the order of detection."""
        at = F.col("detection_index").cast("double") if "detection_index" in rows.columns else F.lit(0.0)
        place = F.struct("part", "place") if {"part", "place"} <= set(rows.columns) else F.struct(F.lit(0).alias("part"), F.struct(*(F.lit(0.0).alias(c) for c in ("rank", "line_id", "x", "token_seq"))).alias("place"))
        return rows.select(*columns, F.struct(F.lit(late).alias("late"), at.alias("at"), place.alias("place"), F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x")).alias("_order"))

    # Dealt by page once, in one branch from the union on.
    page = Window.partitionBy(*PAGE)
    rows = ordered(current, 0).unionByName(ordered(recovered, 1))
    rows = rows.withColumns({"_had": F.coalesce(F.max(is_id & ~late).over(page), F.lit(False)), "_new": F.max(late).over(page)})
    # All kinds but recovered ones that are no ids on pages that had one, all kinds but the page's own text on new pages.
    rows = rows.where(F.when(F.col("_had"), ~late | is_id).otherwise(late | ~F.col("_new") | ~_is_text()))
    # Only ids of pages that had one are settled; the rest of a page is kept as it is.
    rows = rows.withColumn("_settled", F.col("_had") & is_id).withColumn("_id", F.when(F.col("_settled"), F.col("value"))).drop("_had", "_new")
    overlap = lambda a, b: a["_settled"] & b["_settled"] & G.boxes_overlap(a["bbox"], b["bbox"])
    return greedy(rows, [*PAGE, "_id"], [F.col("_order")], overlap, lambda one, other: ~one["suspicious"] & other["suspicious"] & overlap(one, other)).select(*columns)


#: Columns of tokens that passes are compared by.
TOKEN = [*PAGE, "line_id", "token_seq", "text", "x", "y", "w", "h", "confidence"]
_FOUND = [*PAGE, "kind", "bbox", "mask_bbox", "value", "confidence", "suspicious", "part", "place"]

#: (pages wanted, name of the pass) -> what that pass gives for them; see reconcile_on_demand.
Reader = Callable[[DataFrame, str], DataFrame]


def _text(rows: DataFrame) -> DataFrame:
    return detect_text(rows).select(*_FOUND)


def _recover_on_demand(first: DataFrame, found: DataFrame, size: DataFrame, read: Reader) -> DataFrame:
    """As recover_from_bands, but each band is read only of pages that the bands before have not settled."""
    open_pages = written(_flagged(found).join(size, PAGE, "right").where(~F.coalesce("has_id", F.lit(False)) | F.coalesce("doubt", F.lit(False))).select(size.columns), "open")
    is_id = F.col("kind") == "aadhaar"
    doubts = found.where(is_id & F.col("suspicious")).withColumn("doubt_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("bbox.x", "bbox.y", "value")))
    doubts = written(doubts.select(*PAGE, "value", "bbox", "doubt_no"), "doubts")
    seen, steps = first.select(*TOKEN), None
    for band in range(len(BANDS)):
        plan = dealt(band_plan(open_pages).where(F.col("band") == band))
        read_now = written(read(open_pages.join(plan, PAGE), "band").select(*TOKEN, "band"), "band")
        seen = seen.unionByName(translate_band_tokens(read_now, plan, first).select(*TOKEN))
        # Pages whose band is empty are left out of this step, as if it were not there.
        hits = _text(seen.join(plan.select(*PAGE), PAGE))
        ids = settle_ids(hits.where(is_id), PAGE, [F.col("part"), F.col("place")]).select(_FOUND)
        step = written(hits.where(~is_id).unionByName(ids).withColumn("step", F.lit(band)), "step")
        clean = step.where(is_id & ~F.col("suspicious")).select(*PAGE, "value", F.col("bbox").alias("clean_box"))
        cleared = doubts.join(clean, [*PAGE, "value"]).where(G.boxes_overlap(F.col("bbox"), F.col("clean_box"))).groupBy(*PAGE).agg(F.count_distinct("doubt_no").alias("cleared"))
        done = doubts.groupBy(*PAGE).agg(F.count("*").alias("doubts")).join(cleared, PAGE).where(F.col("cleared") == F.col("doubts"))
        open_pages = written(open_pages.join(done, PAGE, "left_anti"), "open")
        steps = step if steps is None else steps.unionByName(step)
    last = steps.where(is_id).groupBy(*PAGE).agg(F.max("step").alias("step"))
    return steps.join(last, [*PAGE, "step"], "left_semi").drop("step")


def reconcile_on_demand(pages: DataFrame, read: Reader, others: Reader, auto_rotate: bool = False) -> DataFrame:
    """The detections of each page after all passes, with the rotation that was applied (0 for none).

    Each pass is asked only for the pages that those before left without an answer. pages: width, height and kind, which decides
    the path: an image without text hit is read enhanced; one that still has none is, with auto_rotate, probed in
    three rotations and, where one wins, read anew as turned; images and pdf pages without id, or with a suspicious one, are read in
    bands, one after the other, until each suspicious id is settled. A blob, an image that cannot be drawn, keeps the text of its first
    pass and has neither faces nor codes.

    read(wanted, name) gives tokens of the wanted pages, which have pages' columns and rotation, and for bands also band, y0 and y1; its
    result has the columns of tokens, for probe and turned also rotation, for bands also band, in band coordinates. name is
    first, enhanced, probe, turned or band. others(wanted, name) gives faces and codes (name first or turned). turned pages
    have their own width and height.
    """
    rows = pages.withColumn("rotation", F.lit(0))
    image, paper = F.col("kind") == "image", F.col("kind").isin("image", "pdf")

    def other(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.lit(None).cast(hit.schema[c].dataType).alias(c) if c in ("part", "place") else F.col(c) for c in _FOUND))

    first = written(read(rows, "first").select(*TOKEN), "first")
    hit = written(_text(first), "hits")
    blank = rows.where(image).join(hit.select(*PAGE).distinct(), PAGE, "left_anti").select(rows.columns)
    enhanced = written(read(blank, "enhanced").select(*TOKEN), "enhanced")
    better = written(_text(enhanced), "better")
    swapped = better.select(*PAGE).distinct()
    first = first.join(swapped, PAGE, "left_anti").unionByName(enhanced.join(swapped, PAGE, "left_semi"))
    found, size = hit.unionByName(better), rows
    if auto_rotate:
        blank = blank.join(swapped, PAGE, "left_anti").drop("rotation")
        probes = blank.withColumn("rotation", F.explode(F.array(*map(F.lit, ROTATIONS))))
        winners = written(probe_rotation(written(read(probes, "probe"), "probes")).select(*PAGE, "rotation"), "winners")
        turned = blank.join(winners, PAGE).withColumn("_to", G.rotated_dims(F.col("width"), F.col("height"), F.col("rotation")))
        turned = turned.withColumns({"width": F.col("_to.width"), "height": F.col("_to.height")}).select(rows.columns)
        again = written(read(turned, "turned").select(*TOKEN), "turned")
        upright = rows.join(winners, PAGE, "left_anti").select(rows.columns)
        found = found.join(winners, PAGE, "left_anti").unionByName(_text(again)).unionByName(other(others(turned, "turned")))
        first, size = first.join(winners, PAGE, "left_anti").unionByName(again), upright.unionByName(turned)
    else:
        upright = rows
    found = found.unionByName(other(others(upright.where(F.col("kind") != "blob"), "first")))
    found, first, size = written(found, "found"), written(first, "effective"), written(size, "size")
    merged = merge_recovery(found, _recover_on_demand(first, found, size.where(paper), read))
    return merged.select(*_FOUND[:-2]).join(size.select(*PAGE, "rotation"), PAGE, "left").withColumn("rotation", F.coalesce("rotation", F.lit(0)))


def recogniser(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> Reader:
    """A reader that has a user's recogniser read the wanted pages (see sources.tokens.with_recognizer). Its batches have a column pass beside
    those of the wanted pages; schema: what it gives."""

    def read(wanted: DataFrame, name: str) -> DataFrame:
        return with_recognizer(wanted.withColumn("pass", F.lit(name)), load, schema)

    return read


def reconcile(
    tokens: DataFrame, others: DataFrame, enhanced_tokens: DataFrame, probe_tokens: DataFrame, rotated_tokens: DataFrame,
    rotated_others: DataFrame, band_tokens: DataFrame, pages: DataFrame, auto_rotate: bool = False,
) -> DataFrame:
    """reconcile_on_demand over passes that were all read beforehand, as tables.

    probe_tokens, rotated_tokens, rotated_others and band_tokens have a column rotation (0 for bands of upright pages).
    pages: width, height and optionally kind (image where it is not given) and drawable; pages of which that is false keep what the first pass found.
    """
    passes = {"first": tokens, "enhanced": enhanced_tokens, "probe": probe_tokens, "turned": rotated_tokens, "band": band_tokens}
    keys = {"first": PAGE, "enhanced": PAGE, "probe": [*PAGE, "rotation"], "turned": [*PAGE, "rotation"], "band": [*PAGE, "rotation", "band"]}
    known = pages if "kind" in pages.columns else pages.withColumn("kind", F.lit("image"))
    if "drawable" in pages.columns:
        known = known.withColumn("kind", F.when(F.coalesce("drawable", F.lit(False)), F.col("kind")).otherwise("still")).drop("drawable")
    read = lambda wanted, name: passes[name].join(wanted.select(*keys[name]), keys[name], "left_semi")
    faces = lambda wanted, name: (others if name == "first" else rotated_others).join(wanted.select(*keys[name]), keys[name], "left_semi")
    return reconcile_on_demand(known, read, faces, auto_rotate)
