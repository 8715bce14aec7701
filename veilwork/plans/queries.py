"""One query for each operator over derived tables, and the same in SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.checksum import check_digit_sql, verhoeff_check_digit, verhoeff_fold_sql, verhoeff_valid
from veilwork.operators import detect, reports
from veilwork.plans.fixtures import codes_table, ctes, derived
from veilwork.sources.staging import written_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL behind the derived tables that it needs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{ctes(*needs)}, {sql.strip()[5:]}" if needs and sql.strip().upper().startswith("WITH") else f"{ctes(*needs)} {sql}" if needs else sql
        return f

    return add


def flat(df: DataFrame, *boxes: str) -> DataFrame:
    """Boxes as columns of their own."""
    out = df
    for b in boxes:
        out = out.withColumns({f"{b}_{c}": F.col(f"{b}.{c}") for c in "xywh"})
    return out.drop(*boxes)


def _valid(text: str) -> str:
    return f"({verhoeff_fold_sql(text, 12)} = 0)"


# Checksums

@query(f"SELECT k, id, {_valid('id')} AS valid FROM ids", "ids")
def verhoeff_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "ids").withColumn("valid", verhoeff_valid("id"))


@query(f"SELECT p_partkey, {check_digit_sql('t', 7)} AS digit FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS t FROM part)")
def verhoeff_check_digits(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "part").select("p_partkey", verhoeff_check_digit(F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("digit"))


@query(f"""WITH v AS (SELECT id FROM ids WHERE {_valid('id')}),
    p AS (SELECT id, unnest(range(1, 13)) AS i FROM v),
    s AS (SELECT id, i, unnest(range(0, 10)) AS n FROM p),
    t AS (SELECT 'substitution' AS error, concat(substr(id, 1, i - 1), n, substr(id, i + 1)) AS text FROM s WHERE CAST(substr(id, i, 1) AS INT) <> n
          UNION ALL SELECT 'swap', concat(substr(id, 1, i - 1), substr(id, i + 1, 1), substr(id, i, 1), substr(id, i + 2)) FROM p
          WHERE i < 12 AND substr(id, i, 1) <> substr(id, i + 1, 1))
    SELECT error, count(*) AS errors, count(*) FILTER (WHERE NOT {_valid('text')}) AS detected FROM t GROUP BY 1""", "ids")
def checksum_audit(spark: SparkSession, d: str) -> DataFrame:
    return reports.checksum_audit(derived(spark, d, "ids"))


_RANDOM = "lpad(CAST((l_orderkey * 1103515245 + l_linenumber * 2654435761 + l_partkey * 40503) % 1000000000000 AS STRING), 12, '0')"


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_valid('id')}) AS passed FROM (SELECT {_RANDOM} AS id FROM lineitem)")
def random_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return reports.random_pass_rate(derived(spark, d, "lineitem").select(F.expr(_RANDOM).alias("id")))


# Detection

_TRIPLETS = f"""g AS (SELECT doc_id, page_index, line_id, x, token_seq, y, w, h, confidence,
        CASE WHEN regexp_full_match(text, '[^0-9]*[0-9]{{4}}[^0-9]*') THEN regexp_extract(text, '[0-9]{{4}}') END AS t FROM tokens),
    l AS (SELECT *, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, lead(x + w) OVER o AS r2, lead(x + w, 2) OVER o AS r3,
        lead(confidence) OVER o AS c2, lead(confidence, 2) OVER o AS c3 FROM g WINDOW o AS (PARTITION BY doc_id, page_index, line_id ORDER BY x, token_seq)),
    triplets AS (SELECT doc_id, page_index, line_id, x, token_seq, concat(t, t2, t3) AS value, x AS bbox_x, y AS bbox_y, r3 - x AS bbox_w, h AS bbox_h,
        x AS mask_bbox_x, y AS mask_bbox_y, r2 - x AS mask_bbox_w, h AS mask_bbox_h, least(confidence, c2, c3) AS confidence, false AS suspicious
        FROM l WHERE t IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL AND {_valid('concat(t, t2, t3)')})"""
_INLINE = f"""m AS (SELECT *, regexp_extract(text, '\\b([0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}})\\b', 1) AS hit FROM tokens),
    n AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS value FROM m WHERE hit <> ''),
    inlines AS (SELECT doc_id, page_index, line_id, x, token_seq, value, x AS bbox_x, y AS bbox_y, w AS bbox_w, h AS bbox_h,
        x + w * (instr(text, hit) - 1) / length(text) AS mask_bbox_x, y AS mask_bbox_y,
        w * length(regexp_extract(hit, '^(?:[^0-9]*[0-9]){{8}}')) / length(text) AS mask_bbox_w, h AS mask_bbox_h, confidence,
        NOT (w / (length(text) * h) BETWEEN 0.4 AND 1.3) AS suspicious FROM n WHERE {_valid('value')})"""
_OVERLAP = "a.bbox_x < b.bbox_x + b.bbox_w AND b.bbox_x < a.bbox_x + a.bbox_w AND a.bbox_y < b.bbox_y + b.bbox_h AND b.bbox_y < a.bbox_y + a.bbox_h"
# Values of the derived tokens meet in one triplet and one inline hit, or one clean and one suspicious hit, at most.
_MERGED = f"""ranked AS (SELECT *, 0 AS rank FROM triplets UNION ALL SELECT *, CASE WHEN suspicious THEN 2 ELSE 1 END FROM inlines),
    merged AS (SELECT * FROM ranked a WHERE rank = 0 OR NOT EXISTS (SELECT 1 FROM ranked b WHERE a.doc_id = b.doc_id AND a.page_index = b.page_index
        AND a.value = b.value AND b.rank < a.rank AND {_OVERLAP}))"""
_PANS = """pans AS (SELECT doc_id, page_index, line_id, x, token_seq, text AS value, x AS bbox_x, y AS bbox_y, w AS bbox_w, h AS bbox_h,
        x AS mask_bbox_x, y AS mask_bbox_y, w AS mask_bbox_w, h AS mask_bbox_h, confidence, false AS suspicious
        FROM tokens WHERE regexp_full_match(text, '[A-Z]{3}[PFCHATBLJG][A-Z][0-9]{4}[A-Z]'))"""
_MRZ = """lines AS (SELECT doc_id, page_index, line_id, string_agg(regexp_replace(upper(text), '[^A-Z0-9<]', '', 'g'), '' ORDER BY x, token_seq) AS line,
        min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b, min(confidence) AS c FROM tokens GROUP BY 1, 2, 3),
    two AS (SELECT *, lead(line) OVER o AS line2, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(r) OVER o AS r2, lead(b) OVER o AS b2, lead(c) OVER o AS c2
        FROM lines WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY line_id)),
    mrz AS (SELECT doc_id, page_index, line_id, least(x, x2) AS x, 0 AS token_seq, concat(line, chr(10), line2) AS value, least(x, x2) AS bbox_x, least(y, y2) AS bbox_y,
        greatest(r, r2) - least(x, x2) AS bbox_w, greatest(b, b2) - least(y, y2) AS bbox_h, least(x, x2) AS mask_bbox_x, least(y, y2) AS mask_bbox_y,
        greatest(r, r2) - least(x, x2) AS mask_bbox_w, greatest(b, b2) - least(y, y2) AS mask_bbox_h, least(1.0, c, c2) AS confidence, false AS suspicious
        FROM two WHERE regexp_full_match(line, 'P<IND[A-Z<]{39}')
        AND regexp_full_match(line2, '[A-Z0-9<]{9}[0-9<]IND[0-9]{6}[0-9][MF<][0-9]{6}[0-9][A-Z0-9<]{14}[0-9]{2}'))"""
_BOXES = ", ".join(f"{b}_{c}" for b in ("bbox", "mask_bbox") for c in "xywh")
_COMMON = f"doc_id, page_index, {_BOXES}, value, confidence, suspicious"


def _common(df: DataFrame) -> DataFrame:
    return flat(df.select(*detect.PAGE, "bbox", "mask_bbox", "value", "confidence", "suspicious"), "bbox", "mask_bbox")


@query(f"WITH {_TRIPLETS} SELECT {_COMMON} FROM triplets", "tokens")
def id12_triplets(spark: SparkSession, d: str) -> DataFrame:
    return _common(detect.detect_id12_triplets(derived(spark, d, "tokens")))


@query(f"WITH {_INLINE} SELECT {_COMMON} FROM inlines", "tokens")
def id12_inline(spark: SparkSession, d: str) -> DataFrame:
    return _common(detect.detect_id12_inline(derived(spark, d, "tokens")))


@query(f"WITH {_TRIPLETS}, {_INLINE}, {_MERGED} SELECT {_COMMON} FROM merged", "tokens")
def id12_merged(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "tokens")
    return _common(detect.merge_id12(detect.detect_id12_triplets(t), detect.detect_id12_inline(t)))


@query(f"WITH {_PANS} SELECT {_COMMON} FROM pans", "tokens")
def pan_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _common(detect.detect_pan(derived(spark, d, "tokens")))


@query(f"WITH {_MRZ} SELECT {_COMMON} FROM mrz", "tokens")
def mrz_lines(spark: SparkSession, d: str) -> DataFrame:
    return _common(detect.detect_mrz(derived(spark, d, "tokens")))


_TEXT = f"""{_TRIPLETS}, {_INLINE}, {_MERGED}, {_PANS}, {_MRZ},
    texts AS (SELECT 'aadhaar' AS kind, 0 AS part, CAST(rank AS DOUBLE) AS rank, line_id, x, token_seq, {_COMMON} FROM merged
        UNION ALL SELECT 'pan', 1, 0, line_id, x, token_seq, {_COMMON} FROM pans UNION ALL SELECT 'passport_mrz', 2, 0, line_id, x, token_seq, {_COMMON} FROM mrz)"""


@query(f"WITH {_TEXT} SELECT kind, {_COMMON} FROM texts", "tokens")
def detect_text(spark: SparkSession, d: str) -> DataFrame:
    return flat(detect.detect_text(derived(spark, d, "tokens")).drop("part", "place"), "bbox", "mask_bbox")


# Greedy suppression keeps a box unless one kept before clashes; a recursive query takes the boxes of a page in order.
_SHARED = """(greatest(0, least(a.bbox_x + a.bbox_w, k.x + k.w) - greatest(a.bbox_x, k.x)) * greatest(0, least(a.bbox_y + a.bbox_h, k.y + k.h) - greatest(a.bbox_y, k.y)))"""
_SIMILAR = f"{_SHARED} > 0 AND {_SHARED} / (a.bbox_w * a.bbox_h + k.w * k.h - {_SHARED}) > 0.3"
_TOUCHED = "a.bbox_x < k.x + k.w AND k.x < a.bbox_x + a.bbox_w AND a.bbox_y < k.y + k.h AND k.y < a.bbox_y + a.bbox_h"


def _greedy_sql(rows: str, order: str, out: str, clash: str = _SIMILAR, more: str = "") -> str:
    """rows has doc_id, page_index (and the column `more`) and bbox columns; the kept ones of each key, by order, are in out. clash compares a box a with a kept one k."""
    key = f"doc_id, page_index{more and ', ' + more}"
    same = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in key.split(", ")).format
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS no FROM {rows}),
    {out}_s AS (SELECT {key}, 0 AS no, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS kept, true AS keep FROM {out}_n GROUP BY ALL
        UNION ALL SELECT {", ".join("s." + c for c in key.split(", "))}, a.no, CASE WHEN c.clash THEN s.kept ELSE list_append(s.kept, {{'x': a.bbox_x, 'y': a.bbox_y, 'w': a.bbox_w, 'h': a.bbox_h}}) END, NOT c.clash
        FROM {out}_s s JOIN {out}_n a ON {same("a", "s")} AND a.no = s.no + 1,
        LATERAL (SELECT coalesce(bool_or({clash}), false) AS clash FROM (SELECT unnest(s.kept) AS k) AS u) AS c),
    {out} AS (SELECT n.* FROM {out}_n n JOIN {out}_s s ON {same("n", "s")} AND n.no = s.no WHERE s.keep)"""


_FACES = """face_boxes AS (SELECT doc_id, page_index, model, score AS confidence, greatest(0, floor(origin_x + 0.5)) AS bbox_x, greatest(0, floor(origin_y + 0.5)) AS bbox_y,
        floor(width + 0.5) AS bbox_w, floor(height + 0.5) AS bbox_h FROM faces WHERE score >= 0.5 AND origin_x IS NOT NULL)"""
_KEPT_FACES = f"{_FACES}, {_greedy_sql('face_boxes', 'confidence DESC, model, bbox_x, bbox_y', 'kept_faces')}"
_CODES = """code_boxes AS (SELECT doc_id, page_index, priority, payload AS value, qx AS bbox_x, qy AS bbox_y, qw AS bbox_w, qw AS bbox_h,
        CASE WHEN length(payload) >= 500 OR contains(payload, '<?xml') OR contains(payload, 'PrintLetterBarcodeData') THEN 'uidai_qr' ELSE 'other_qr' END AS kind
        FROM codes WHERE NOT lost AND (source = 'native' OR length(payload) >= 8))"""
_KEPT_CODES = f"{_CODES}, {_greedy_sql('code_boxes', 'priority, bbox_x, bbox_y, value', 'kept_codes')}"
_FACE_COLUMNS = "doc_id, page_index, bbox_x, bbox_y, bbox_w, bbox_h, confidence"


def _with_recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def recursive(f: Query) -> Query:
    ORACLE_SQL[f.__name__] = _with_recursive(ORACLE_SQL[f.__name__])
    return f


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return detect.merge_faces(derived(spark, d, "faces"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return detect.compose_qr(detect.detect_qr(codes_table(spark, d)))


@recursive
@query(f"WITH {_KEPT_FACES} SELECT {_FACE_COLUMNS} FROM kept_faces", "faces")
def merge_faces(spark: SparkSession, d: str) -> DataFrame:
    return flat(_faces(spark, d).select(*detect.PAGE, "bbox", "confidence"), "bbox")


# Coverage in SQL: each face column of one pixel, each of its token stretches, and what reaches beyond all earlier ones.
_COVER = f"""cover AS (SELECT f.*, coalesce((SELECT sum(fresh) FROM (
        SELECT greatest(0, y2 - greatest(y1, coalesce(max(y2) OVER (PARTITION BY c ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y1))) AS fresh
        FROM (SELECT r.c, greatest(t.y, f.bbox_y) AS y1, least(t.y + t.h, f.bbox_y + f.bbox_h) AS y2
              FROM tokens t, (SELECT unnest(range(0, CAST(ceil(f.bbox_w) AS BIGINT))) AS c) AS r
              WHERE t.doc_id = f.doc_id AND t.page_index = f.page_index AND t.x <= f.bbox_x + r.c AND f.bbox_x + r.c < t.x + t.w AND t.y < f.bbox_y + f.bbox_h AND t.y + t.h > f.bbox_y))), 0)
        / (f.bbox_w * f.bbox_h) AS coverage FROM kept_faces f)"""


@recursive
@query(f"WITH {_KEPT_FACES}, {_COVER} SELECT {_FACE_COLUMNS}, coverage FROM cover", "faces", "tokens")
def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    return flat(detect.text_coverage(_faces(spark, d), derived(spark, d, "tokens")).select(*detect.PAGE, "bbox", "confidence", "coverage"), "bbox")


@recursive
@query(f"WITH {_KEPT_FACES}, {_COVER} SELECT {_FACE_COLUMNS} FROM cover WHERE coverage < 0.1", "faces", "tokens")
def reject_text_faces(spark: SparkSession, d: str) -> DataFrame:
    return flat(detect.reject_text_faces(_faces(spark, d), derived(spark, d, "tokens"), 0.1).select(*detect.PAGE, "bbox", "confidence"), "bbox")


@query(f"WITH {_CODES} SELECT doc_id, page_index, kind, priority, bbox_x, bbox_y, bbox_w, bbox_h, value FROM code_boxes", "codes")
def classify_qr(spark: SparkSession, d: str) -> DataFrame:
    return flat(detect.detect_qr(codes_table(spark, d)).select(*detect.PAGE, "kind", "priority", "bbox", "value"), "bbox")


@recursive
@query(f"WITH {_KEPT_CODES} SELECT doc_id, page_index, kind, bbox_x, bbox_y, bbox_w, bbox_h, value FROM kept_codes", "codes")
def compose_qr(spark: SparkSession, d: str) -> DataFrame:
    return flat(_codes(spark, d).select(*detect.PAGE, "kind", "bbox", "value"), "bbox")


@query(f"""WITH {_CODES} SELECT doc_id, page_index, kind, value FROM code_boxes a WHERE priority = 0 OR NOT EXISTS
    (SELECT 1 FROM code_boxes b WHERE b.priority = 0 AND a.doc_id = b.doc_id AND a.page_index = b.page_index)""", "codes")
def fallback_when_empty(spark: SparkSession, d: str) -> DataFrame:
    codes = detect.detect_qr(codes_table(spark, d))
    return detect.fallback_when_empty(codes.where("priority = 0"), codes.where("priority = 1")).select(*detect.PAGE, "kind", "value")


_PAGE = f"""{_TEXT}, {_KEPT_FACES}, {_KEPT_CODES},
    every AS (SELECT kind, part, rank, CAST(line_id AS DOUBLE) AS o2, CAST(x AS DOUBLE) AS o3, CAST(token_seq AS DOUBLE) AS o4, {_COMMON} FROM texts
        UNION ALL SELECT 'face', 3, -confidence, bbox_x, bbox_y, 0, doc_id, page_index, bbox_x, bbox_y, bbox_w, bbox_h, bbox_x, bbox_y, bbox_w, bbox_h, 'face', confidence, false FROM kept_faces
        UNION ALL SELECT kind, 4, priority, bbox_x, bbox_y, 0, doc_id, page_index, bbox_x, bbox_y, bbox_w, bbox_h, bbox_x, bbox_y, bbox_w, bbox_h, value, 1, false FROM kept_codes),
    detections AS (SELECT kind, {_COMMON}, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY part, rank, o2, o3, o4, value) - 1 AS INT) AS detection_index FROM every)"""


def page_detections(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, exports and reports read the detections as a written table, as they would in production."""
    build = lambda: detect.detect_page(derived(spark, d, "tokens"), _faces(spark, d), _codes(spark, d))
    return written_once(spark, "detections", d, build)


def brief_detections(spark: SparkSession, d: str) -> DataFrame:
    """The same without values, for what reads none of them."""
    build = lambda: detect.detect_page_brief(derived(spark, d, "tokens"), _faces(spark, d), _codes(spark, d))
    return written_once(spark, "brief", d, build)


def counted_detections(spark: SparkSession, d: str) -> DataFrame:
    """The same without order, for counts: read once, so not written."""
    return detect.page_parts(derived(spark, d, "tokens"), _faces(spark, d), _codes(spark, d))


def other_detections(spark: SparkSession, d: str) -> DataFrame:
    """Faces and codes only: text need not be detected for them."""
    build = lambda: _faces(spark, d).select(*detect.DETECTION).unionByName(_codes(spark, d).select(*detect.DETECTION))
    return written_once(spark, "others", d, build)


def text_detections(spark: SparkSession, d: str) -> DataFrame:
    return written_once(spark, "texts", d, lambda: detect.detect_text(derived(spark, d, "tokens")).drop("part", "place"))


@recursive
@query(f"WITH {_PAGE} SELECT kind, detection_index, {_COMMON} FROM detections", "tokens", "faces", "codes")
def detect_page(spark: SparkSession, d: str) -> DataFrame:
    return flat(detect.detect_page(derived(spark, d, "tokens"), _faces(spark, d), _codes(spark, d)), "bbox", "mask_bbox")
