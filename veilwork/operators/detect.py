"""Detections from recognised tokens, face boxes and code payloads.

tokens: doc_id, page_index, line_id, token_seq, text, x, y, w, h, confidence. All work is keyed by
(doc_id, page_index), in windows by line. Detections carry doc_id, page_index, kind, bbox, mask_bbox, value,
confidence, suspicious and, within a page, the place `ordinal` in the order that toggles refer to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwork.functions import geometry as G
from veilwork.functions import text as X
from veilwork.functions.checksum import verhoeff_valid12

PAGE = ["doc_id", "page_index"]
DETECTION = [*PAGE, "kind", "bbox", "mask_bbox", "value", "confidence", "suspicious"]


def _token_box() -> Column:
    return G.box(*(F.col(c) for c in "xywh"))


def _born(rows: DataFrame) -> list[str]:
    """The column _born of rows that have it: a hit has the largest of the tokens that it is made of."""
    return ["_born"] if "_born" in rows.columns else []


def detect_id12_triplets(tokens: DataFrame) -> DataFrame:
    """Every three neighbours on a line, by x, that are pure groups of four digits and valid together.

    The mask covers the first two. Windows overlap; nothing is merged here. The groups are checked before
    the checksum, so few rows reach it.
    """
    line = Window.partitionBy(*PAGE, "line_id").orderBy("x", "token_seq")
    cell = F.struct(X.pure_group(F.col("text")).alias("digits"), _token_box().alias("box"), F.col("confidence").cast("double").alias("confidence"), *_born(tokens))
    rows = tokens.select(*PAGE, "line_id", "x", "token_seq", cell.alias("one"))
    rows = rows.withColumns({"two": F.lead("one", 1).over(line), "three": F.lead("one", 2).over(line)})
    rows = rows.where(F.col("one.digits").isNotNull() & F.col("two.digits").isNotNull() & F.col("three.digits").isNotNull())
    rows = rows.withColumn("value", F.concat("one.digits", "two.digits", "three.digits")).where(verhoeff_valid12(F.col("value")))
    both = G.box_union(F.col("one.box"), F.col("two.box"))
    # Lines in order of first appearance, then from left to right.
    return rows.select(
        *PAGE, F.lit("aadhaar").alias("kind"), G.box_union(both, F.col("three.box")).alias("bbox"), both.alias("mask_bbox"), "value",
        F.least("one.confidence", "two.confidence", "three.confidence").alias("confidence"), F.lit(False).alias("suspicious"),
        "line_id", "x", "token_seq", *(F.greatest(f"one.{c}", f"two.{c}", f"three.{c}").alias(c) for c in _born(tokens)),
    )


def detect_id12_inline(tokens: DataFrame) -> DataFrame:
    """The first valid candidate within each token; suspicious where the token's box does not fit its length."""
    first = X.with_valid_id12(tokens, "text", "hit").where(F.col("hit").isNotNull()).withColumn("hit", F.struct(F.col("hit").alias("match"), X.digits_of(F.col("hit")).alias("value")))
    wide = ~X.plausible_glyphs(F.col("w"), F.col("h"), F.length("text"))
    mask = X.mask_sub_box(*(F.col(c).cast("double") for c in "xywh"), F.col("text"), F.col("hit.match"))
    return first.select(
        *PAGE, F.lit("aadhaar").alias("kind"), _token_box().alias("bbox"), mask.cast(G.BOX).alias("mask_bbox"), F.col("hit.value").alias("value"),
        F.col("confidence").cast("double").alias("confidence"), wide.alias("suspicious"), "line_id", "x", "token_seq", *_born(tokens),
    )


def greedy(rows: DataFrame, keys: list[str], order: list[Column], clash, beats=None, ordinal: str | None = None) -> DataFrame:
    """Of each key's rows, in order, those that clash with none kept before: an ordered fold over a short array.

    clash(kept, new) is a condition on two rows; where beats(one, other) is given, rows that any row of the key beats go first. Groups are the detections of a page (or of a page and
    value), bounded by what a page can show; a row alone in its group is kept as it is, so beats(x, x) has to be false.
    """
    payload = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *(c for c in rows.columns if c not in keys))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(payload)).alias("_all"))
    alone = F.size("_all") <= 1
    if beats is not None:
        listed = listed.withColumn("_all", F.when(alone, F.col("_all")).otherwise(F.filter("_all", lambda x: ~F.exists(F.col("_all"), lambda y: beats(y, x)))))
    # An empty array of the right type to begin with.
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    kept = F.when(alone, F.col("_all")).otherwise(kept)
    if ordinal:
        out = listed.select(*keys, F.posexplode(kept).alias(ordinal, "_row")).select(*keys, "_row.*", ordinal)
    else:
        out = listed.select(*keys, F.explode(kept).alias("_row")).select(*keys, "_row.*")
    return out.drop(*(f"_o{i}" for i in range(len(order))))


def merge_id12(triplets: DataFrame, inline: DataFrame) -> DataFrame:
    """Triplets, then inline hits, clean ones first, without those that overlap a kept one of the same value.

    Triplets are all kept. The same value at two places stays twice.
    """
    three = triplets.withColumn("rank", F.lit(0))
    one = inline.withColumn("rank", F.when(F.col("suspicious"), 2).otherwise(1))
    rows = three.unionByName(one)
    order = [F.col("rank"), F.col("line_id"), F.col("x"), F.col("token_seq")]
    return greedy(rows, [*PAGE, "value"], order, lambda k, x: (x["rank"] > 0) & G.boxes_overlap(k["bbox"], x["bbox"]))


def detect_pan(tokens: DataFrame) -> DataFrame:
    rows = tokens.where(X.is_pan(F.col("text")))
    return rows.select(
        *PAGE, F.lit("pan").alias("kind"), _token_box().alias("bbox"), _token_box().alias("mask_bbox"), X.trim(F.col("text")).alias("value"),
        F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("suspicious"), "line_id", "x", "token_seq", *_born(tokens),
    )


def mrz_lines(tokens: DataFrame, *more: str) -> DataFrame:
    """The sanitized text of each line, its hull and least confidence. A line's tokens are bounded by the page. more: columns that are one for each line."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("x", "token_seq", "text"))), lambda t: X.mrz_sanitize(t["text"]))
    born = [F.max("_born").alias("_born")] if "_born" in tokens.columns else []
    return tokens.groupBy(*PAGE, "line_id", *more).agg(
        F.concat_ws("", parts).alias("line"), G.hull_agg(*(F.col(c).cast("double") for c in "xywh")).alias("box"), F.min(F.col("confidence").cast("double")).alias("confidence"), *born
    )


def detect_mrz(tokens: DataFrame) -> DataFrame:
    """Two neighbouring lines, among those present, that are a passport's.

    Lines are numbered and their characters counted first: only lines of a passport line's length are put together.
    """
    length = F.length(X.mrz_sanitize(F.col("text")))
    rows = tokens.select(*PAGE, "line_id", "x", "token_seq", "text", "y", "w", "h", "confidence", length.alias("_n"), *_born(tokens))
    rows = rows.withColumn("line_no", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line_id")))
    rows = rows.withColumn("_n", F.sum("_n").over(Window.partitionBy(*PAGE, "line_id"))).where(F.col("_n") == X.MRZ_LENGTH)
    lines = mrz_lines(rows.drop("_n"), "line_no")
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    rows = lines.withColumn("next", F.lead(F.struct("line_no", "line", "box", "confidence", *_born(tokens))).over(page)).where(F.col("next.line_no") == F.col("line_no") + 1)
    rows = rows.where(X.is_mrz_line1(F.col("line")) & X.is_mrz_line2(F.col("next.line")))
    hull = G.box_union(F.col("box"), F.col("next.box"))
    return rows.select(
        *PAGE, F.lit("passport_mrz").alias("kind"), hull.alias("bbox"), hull.alias("mask_bbox"), F.concat_ws("\n", "line", "next.line").alias("value"),
        F.least(F.lit(1.0), "confidence", "next.confidence").alias("confidence"), F.lit(False).alias("suspicious"),
        "line_id", F.col("box.x").alias("x"), F.lit(0).alias("token_seq"), *(F.greatest(c, f"next.{c}").alias(c) for c in _born(tokens)),
    )


#: Columns of a hit, beside those of its page.
_HIT = ["kind", "bbox", "mask_bbox", "value", "confidence", "suspicious", "part", "place"]


def _hits(tokens: DataFrame) -> DataFrame:
    """All that the four detectors find, in one pass over the lines of each page, which are dealt by page once; nothing is merged yet.

    Where tokens have a column _only, each of its values is a reading of the page of its own.
    """
    born, text = _born(tokens), F.col("text")
    page = [*PAGE, *(["_only"] if "_only" in tokens.columns else [])]
    rows = tokens.select(*page, "line_id", "x", "token_seq", "text", "y", "w", "h", F.col("confidence").cast("double").alias("confidence"), *born).repartition(*PAGE)
    # Short texts need no regular expression. Upper case has three characters for one at most, and one for ASCII.
    rows = rows.withColumn("_group", F.when(F.length(text) >= 4, X.group_match(text)))
    digits = F.nullif(F.col("_group"), F.lit(""))
    most = F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(3 * F.length(text))
    cell = F.when(digits.isNotNull(), F.struct(digits.alias("digits"), _token_box().alias("box"), "confidence", *born))
    rows = rows.withColumns({"one": cell, "_most": most}).drop("_group")
    own = Window.partitionBy(*page, "line_id")
    line = own.orderBy("x", "token_seq")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"two": F.lead("one", 1).over(line), "three": F.lead("one", 2).over(line), "_no": F.row_number().over(line), "_most": F.sum("_most").over(whole)})
    # A passport's line is put together where a line has its length, at its first token.
    clean = X.mrz_sanitize(text)
    rows = rows.withColumn("_n", F.sum(F.when(F.col("_most") >= X.MRZ_LENGTH, F.length(clean))).over(whole))
    sure = F.coalesce(F.col("_n") == X.MRZ_LENGTH, F.lit(False))
    only = lambda c: F.when(sure, F.col(c).cast("double") if c != "_born" else F.col(c))
    hull = G.from_edges(F.min(only("x")).over(whole), F.min(only("y")).over(whole), F.max(only("x") + only("w")).over(whole), F.max(only("y") + only("h")).over(whole))
    rows = rows.withColumns({"_texts": F.collect_list(F.when(sure, F.struct("x", "token_seq", "text"))).over(whole), "_hull": hull, "_least": F.min(only("confidence")).over(whole), **{"_last": F.max(only(c)).over(whole) for c in born}})
    joined = F.concat_ws("", F.transform(F.sort_array("_texts"), lambda t: X.mrz_sanitize(t["text"])))
    mrz = F.when(sure & (F.col("_no") == 1), F.struct(joined.alias("line"), F.col("_hull").alias("box"), F.col("_least").alias("confidence"), *(F.col("_last").alias(c) for c in born)))
    rows = rows.withColumn("_mrz", mrz).drop("_texts", "_hull", "_least", "_last")
    rows = rows.withColumn("_line_no", F.sum(F.when(F.col("_no") == 1, 1)).over(Window.partitionBy(*page).orderBy("line_id")))
    rows = rows.withColumn("_next", F.first("_mrz", ignorenulls=True).over(Window.partitionBy(*page).orderBy("_line_no").rangeBetween(1, 1)))

    place = lambda rank, x, seq: F.struct(*(c.cast("double").alias(n) for c, n in ((rank, "rank"), (F.col("line_id"), "line_id"), (x, "x"), (seq, "token_seq"))))

    def hit(where: Column, part: int, kind: str, bbox: Column, mask: Column, value: Column, confidence: Column, suspicious: Column, at: Column, last: list[Column]) -> Column:
        values = (F.lit(kind), bbox.cast(G.BOX), mask.cast(G.BOX), value, confidence, suspicious, F.lit(part), at)
        return F.when(where, F.struct(*(v.alias(n) for v, n in zip(values, _HIT, strict=True)), *(c.alias("_born") for c in last)))

    no, x, seq, box = F.lit(False), F.col("x"), F.col("token_seq"), _token_box()
    three = F.when(F.col("two").isNotNull() & F.col("three").isNotNull(), F.concat("one.digits", "two.digits", "three.digits"))
    rows = rows.withColumn("_three", three)
    rows = X.with_valid_id12(rows.withColumn("_three", F.when(verhoeff_valid12(F.col("_three")), F.col("_three"))), "text", "_match")
    both = G.box_union(F.col("one.box"), F.col("two.box"))
    triplet = hit(
        F.col("_three").isNotNull(), 0, "aadhaar", G.box_union(both, F.col("three.box")), both, F.col("_three"), F.least("one.confidence", "two.confidence", "three.confidence"), no,
        place(F.lit(0), x, seq), [F.greatest(f"one.{c}", f"two.{c}", f"three.{c}") for c in born],
    )
    wide = ~X.plausible_glyphs(F.col("w"), F.col("h"), F.length(text))
    mask = X.mask_sub_box(*(F.col(c).cast("double") for c in "xywh"), text, F.col("_match"))
    inline = hit(F.col("_match").isNotNull(), 0, "aadhaar", box, mask, X.digits_of(F.col("_match")), F.col("confidence"), wide, place(F.when(wide, 2).otherwise(1), x, seq), [F.col(c) for c in born])
    pan = hit((F.length(text) >= 10) & X.is_pan(text), 1, "pan", box, box, X.trim(text), F.col("confidence"), no, place(F.lit(0), x, seq), [F.col(c) for c in born])
    pair = F.col("_mrz").isNotNull() & F.col("_next").isNotNull()
    around = G.box_union(F.col("_mrz.box"), F.col("_next.box"))
    passport = hit(
        pair & X.is_mrz_line1(F.col("_mrz.line")) & X.is_mrz_line2(F.col("_next.line")), 2, "passport_mrz", around, around, F.concat_ws("\n", "_mrz.line", "_next.line"),
        F.least(F.lit(1.0), "_mrz.confidence", "_next.confidence"), no, place(F.lit(0), F.col("_mrz.box.x"), F.lit(0)), [F.greatest(f"_mrz.{c}", f"_next.{c}") for c in born],
    )
    # Filtered by a lambda, Spark compiles this in small pieces, where one method for all four kinds would be too long for the JVM to compile;
    # slice, as of a plain column Spark would infer a filter and work it out twice.
    found = rows.select(*page, F.filter(F.array(triplet, inline, pan, passport), lambda h: h.isNotNull()).alias("_found"))
    return found.select(*page, F.explode(F.slice("_found", 1, 4)).alias("_hit")).select(*page, "_hit.*")


def _clash(kept: Column, new: Column) -> Column:
    """merge_id12's rule on hits of one value and part; the other parts have rank 0."""
    return (new["place"]["rank"] > 0) & G.boxes_overlap(kept["bbox"], new["bbox"])


def detect_text(tokens: DataFrame) -> DataFrame:
    """12-digit ids, tax ids and passport lines of each page, with group and place in it for the page order."""
    return greedy(_hits(tokens), [*PAGE, "part", "value"], [F.col("place")], _clash).select(*DETECTION, "part", "place")


def detect_text_steps(tokens: DataFrame, steps: int) -> DataFrame:
    """detect_text where hits live in several steps, ids merged and settled in each step on its own: a row, with a column step, for each step that has the hit.

    tokens have a column _born, and a hit the largest of its tokens: it lives from that step on, through all `steps`, or, of tokens that
    have a step in a column _only, in that one only.
    """
    rows = _hits(tokens if "_only" in tokens.columns else tokens.withColumn("_only", F.lit(None).cast("int")))
    keys = [*PAGE, "_only", "part", "value"]
    payload = F.struct("place", *(c for c in rows.columns if c not in [*keys, "place"]))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(payload)).alias("_all"))
    last = F.coalesce("_only", F.lit(steps - 1))

    def fold(of: Column, clash: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(of, F.slice(of, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))

    def kept(step: Column) -> Column:
        merged = fold(F.filter("_all", lambda x: x["_born"] <= step), _clash)
        # Of merged ids only those of three tokens, which are all kept so far, can still overlap one of their value.
        return F.when(F.col("part") == 0, fold(merged, lambda k, x: (x["place"]["rank"] == 0) & G.boxes_overlap(k["bbox"], x["bbox"]))).otherwise(merged)

    in_step = lambda step, of: F.transform(of, lambda x: F.struct(step.alias("step"), x.alias("row")))
    alone = F.transform(F.sequence(F.get("_all", 0)["_born"], last), lambda s: F.struct(s.alias("step"), F.get("_all", 0).alias("row")))
    many = F.flatten(F.transform(F.sequence(F.array_min(F.transform("_all", lambda x: x["_born"])), last), lambda s: in_step(s, kept(s))))
    out = listed.select(*keys, F.explode(F.when(F.size("_all") == 1, alone).otherwise(many)).alias("_at")).select(*keys, "_at.step", "_at.row.*")
    return out.select(*DETECTION, "part", "place", "step")


def as_part(rows: DataFrame, part: int, *place: Column) -> DataFrame:
    """Rows of a detector with group and place, in the form that detect_page joins."""
    four = [*place, *[F.lit(0.0)] * (4 - len(place))]
    named = F.struct(*(c.cast("double").alias(n) for c, n in zip(four, ("rank", "line_id", "x", "token_seq"), strict=True)))
    return rows.select(*DETECTION, F.lit(part).alias("part"), named.alias("place"))


def numbered(rows: DataFrame) -> DataFrame:
    """Detections with their index on the page, which toggles refer to."""
    page = Window.partitionBy(*PAGE).orderBy("part", "place", "value")
    return rows.select(*DETECTION, (F.row_number().over(page) - 1).alias("detection_index"))


def page_parts(tokens: DataFrame, faces: DataFrame, codes: DataFrame) -> DataFrame:
    """Text detections, then faces by falling confidence, then codes, with group and place."""
    every = detect_text(tokens).unionByName(as_part(faces, 3, -F.col("confidence"), F.col("bbox.x"), F.col("bbox.y")))
    return every.unionByName(as_part(codes, 4, F.col("priority"), F.col("bbox.x"), F.col("bbox.y"), *([F.col("ordinal")] if "ordinal" in codes.columns else [])))


def detect_page(tokens: DataFrame, faces: DataFrame, codes: DataFrame) -> DataFrame:
    return numbered(page_parts(tokens, faces, codes))


def detect_page_brief(tokens: DataFrame, faces: DataFrame, codes: DataFrame) -> DataFrame:
    """detect_page without values, for reviews and counts: payloads of codes do not move again, as their ordinal stands for them in the page's order."""
    return numbered(page_parts(tokens, faces, codes.withColumn("value", F.lit("")))).drop("value")


#: Fixed value: what is written for a face.
FACE_VALUE = "face"
#: Least score of a face, similarity of boxes that are one, text share of a false face.
FACE_SCORE, SAME_BOX, TEXT_SHARE = 0.5, 0.3, 0.5
#: Fixed value: payloads of the second decoder that are shorter are noise.
NOISE = 8


def merge_faces(face_raw: DataFrame, min_confidence: float = FACE_SCORE, same: float = SAME_BOX) -> DataFrame:
    """Faces of all models, most confident first, without those that share more than `same` with one kept."""
    rounded = {c: F.greatest(F.lit(0.0), G.round_half_up(F.col(c)).cast("double")) if c in ("origin_x", "origin_y") else G.round_half_up(F.col(c)).cast("double") for c in ("origin_x", "origin_y", "width", "height")}
    good = face_raw.where((F.col("score") >= min_confidence) & F.col("origin_x").isNotNull() & F.col("origin_y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())
    rows = good.select(*PAGE, G.box(*rounded.values()).alias("bbox"), F.col("score").cast("double").alias("confidence"), "model")
    kept = greedy(rows, PAGE, [-F.col("confidence"), F.col("model"), F.col("bbox.x"), F.col("bbox.y")], lambda k, x: G.iou(k["bbox"], x["bbox"]) > same)
    return kept.select(*PAGE, F.lit("face").alias("kind"), "bbox", F.col("bbox").alias("mask_bbox"), F.lit(FACE_VALUE).alias("value"), "confidence", F.lit(False).alias("suspicious"))


def text_coverage(faces: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add to each face the share of its box that token boxes cover, columns of one pixel from its left edge.

    A column counts where its left edge lies on a token, so a token covers the columns from its left to its right edge rounded up.
    Tokens are joined by page with the overlap as the join's condition. Their distinct edges cut a face into strips in which
    nothing changes: each strip is measured once, by a running maximum over the stretches in it, and counts as many
    times as it has columns. So rows follow the tokens on a face, not its width.
    """
    face_key = [*PAGE, "face_no"]
    own = faces.withColumn("face_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("confidence"), "bbox.x", "bbox.y")))
    f = own.select(*face_key, *(F.col(f"bbox.{c}").alias(f"f{c}") for c in "xywh"))
    hits = f.join(tokens.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in "xywh")), PAGE).where(
        (F.col("x") < F.col("fx") + F.col("fw")) & (F.col("x") + F.col("w") > F.col("fx")) & (F.col("y") < F.col("fy") + F.col("fh")) & (F.col("y") + F.col("h") > F.col("fy"))
    )
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.ceil("fw").cast("double"), F.ceil(c - F.col("fx")).cast("double")))
    spans = hits.select(*face_key, within(F.col("x")).alias("from"), within(F.col("x") + F.col("w")).alias("to"), F.greatest("y", "fy").alias("y1"), F.least(F.col("y") + F.col("h"), F.col("fy") + F.col("fh")).alias("y2"))
    spans = spans.where(F.col("to") > F.col("from"))
    edges = spans.select(*face_key, F.explode(F.array("from", "to")).alias("edge")).distinct()
    strips = edges.withColumn("end", F.lead("edge").over(Window.partitionBy(*face_key).orderBy("edge"))).where(F.col("end").isNotNull())
    parts = spans.join(strips, face_key).where((F.col("from") <= F.col("edge")) & (F.col("edge") < F.col("to")))
    strip = Window.partitionBy(*face_key, "edge").orderBy("y1", "y2")
    before = F.max("y2").over(strip.rowsBetween(Window.unboundedPreceding, -1))
    new = parts.select(*face_key, "edge", "end", F.greatest(F.lit(0.0), F.col("y2") - F.greatest(F.col("y1"), F.coalesce(before, F.col("y1")))).alias("fresh"))
    covered = new.groupBy(*face_key).agg(F.sum(F.col("fresh") * (F.col("end") - F.col("edge"))).alias("covered"))
    size = F.col("bbox.w") * F.col("bbox.h")
    joined = own.join(covered, face_key, "left")
    return joined.withColumn("coverage", F.when(size > 0, F.coalesce("covered", F.lit(0.0)) / size).otherwise(F.lit(0.0))).drop("covered", "face_no")


def reject_text_faces(faces: DataFrame, tokens: DataFrame, share: float = TEXT_SHARE) -> DataFrame:
    return text_coverage(faces, tokens).where(F.col("coverage") < share).drop("coverage")


def detect_qr(qr_raw: DataFrame) -> DataFrame:
    """Codes with a position; the second source's short payloads are noise."""
    rows = qr_raw.where(F.col("position").isNotNull() & ((F.col("source") == "native") | (F.length("payload") >= NOISE)))
    b = G.quad_to_box(F.col("position"))
    return rows.select(*PAGE, X.classify_qr(F.col("payload")).alias("kind"), b.alias("bbox"), b.alias("mask_bbox"), F.col("payload").alias("value"), F.lit(1.0).alias("confidence"), F.lit(False).alias("suspicious"), "priority")


def compose_qr(codes: DataFrame, same: float = SAME_BOX) -> DataFrame:
    """Codes of all sources by priority; the first of boxes that share more than `same` wins. ordinal: the place among a page's kept ones."""
    order = [F.col("priority"), F.col("bbox.x"), F.col("bbox.y"), F.col("value")]
    return greedy(codes, PAGE, order, lambda k, x: G.iou(k["bbox"], x["bbox"]) > same, ordinal="ordinal")


def fallback_when_empty(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second pass on pages for which the first has nothing."""
    return first.unionByName(second.join(first.select(*PAGE).distinct(), PAGE, "left_anti"))


#: What a region is called that looks like a code, and its bounds.
CODE_VALUE = "visual-qr-candidate"
ASPECT, AREA, BIMODAL, FACE_OVERLAP, CODE_CONFIDENCE = (0.75, 1.33), (0.005, 0.25), 0.6, 0.4, 0.4


def grid_components(cells: DataFrame) -> DataFrame:
    """4-neighbour components of a page's cells: rows, columns, cells and bimodal cells of each.

    A page's grid has a few hundred cells at most, so each page is one small group.
    """
    import pandas as pd

    def flood(page: pd.DataFrame) -> pd.DataFrame:
        left = {(r, c): bool(b) for r, c, b in zip(page["row"], page["col"], page["bimodal"], strict=True)}
        out = []
        for start in sorted(left):
            if start not in left:
                continue
            stack, own = [start], {start: left.pop(start)}
            while stack:
                r, c = stack.pop()
                for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if near in left:
                        own[near] = left.pop(near)
                        stack.append(near)
            rows, cols = [k[0] for k in own], [k[1] for k in own]
            out.append((page["doc_id"].iloc[0], page["page_index"].iloc[0], min(rows), max(rows), min(cols), max(cols), len(own), sum(own.values())))
        return pd.DataFrame(out, columns=["doc_id", "page_index", "row1", "row2", "col1", "col2", "cells", "bimodal_cells"])

    return cells.groupBy(*PAGE).applyInPandas(flood, "doc_id long, page_index long, row1 long, row2 long, col1 long, col2 long, cells long, bimodal_cells long")


def locate_qr_cells(cells: DataFrame, pages: DataFrame, faces: DataFrame) -> DataFrame:
    """Regions of textured or bimodal cells without text that look like a code.

    cells: doc_id, page_index, row, col, cell, textured, bimodal, has_text (see raster.cell_stats).
    """
    some = cells.where((F.col("textured") | F.col("bimodal")) & ~F.col("has_text"))
    size = cells.groupBy(*PAGE).agg(F.max("cell").alias("cell"))
    parts = grid_components(some).join(size, PAGE).join(pages.select(*PAGE, "width", "height"), PAGE)
    b = G.from_edges(F.col("col1") * F.col("cell"), F.col("row1") * F.col("cell"), (F.col("col2") + 1) * F.col("cell"), (F.col("row2") + 1) * F.col("cell"))
    rows = parts.withColumn("bbox", b).where((F.col("bbox.w") / F.col("bbox.h")).between(*ASPECT))
    rows = rows.where((G.area(F.col("bbox")) / (F.col("width") * F.col("height"))).between(*AREA) & (F.col("bimodal_cells") / F.col("cells") >= BIMODAL))
    # Measured as a whole, a region is cut to the page: the last cells may reach over it.
    cut = G.box(F.col("bbox.x"), F.col("bbox.y"), F.least(F.col("bbox.w"), F.col("width") - F.col("bbox.x")), F.least(F.col("bbox.h"), F.col("height") - F.col("bbox.y")))
    rows = rows.withColumn("bbox", cut)
    f = faces.select(*(F.col(c).alias(f"_{c}") for c in PAGE), F.col("bbox").alias("face"))
    rows = rows.join(f, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_index") == F.col("_page_index")) & (G.overlap_fraction(F.col("bbox"), F.col("face")) > FACE_OVERLAP), "left_anti")
    rows = rows.select(*PAGE, F.lit("other_qr").alias("kind"), "bbox", F.col("bbox").alias("mask_bbox"), F.lit(CODE_VALUE).alias("value"), F.lit(CODE_CONFIDENCE).alias("confidence"), F.lit(False).alias("suspicious"), F.lit(9).alias("priority"))
    return compose_qr(rows).drop("ordinal")
