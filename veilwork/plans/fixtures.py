"""Token, page, face, code, form and pixel tables that SQL derives from the given tables.

The given tables hold no ids, so ids are made from keys by arithmetic that Spark and DuckDB share: each text here
runs on both. In Spark a table is read with `derived`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.checksum import check_digit_sql
from veilwork.sources.staging import written_once

_IDS = f"""
    SELECT k, CASE WHEN k % 8 = 5 THEN concat(body, CAST((CAST(c AS INT) + 1) % 10 AS STRING)) ELSE concat(body, c) END AS id
    FROM (SELECT k, body, {check_digit_sql("body", 11)} AS c
          FROM (SELECT o_orderkey AS k, lpad(CAST((o_orderkey * 1103515245 + 12345) % 100000000000 AS STRING), 11, '0') AS body FROM orders) AS b) AS d
"""


def _letter(n: str) -> str:
    return f"chr(CAST(65 + ({n}) % 26 AS INT))"


def _token(seq: int, text: str, x: str, w: str, h: str, where: str) -> str:
    return f"""
    SELECT CAST(floor(k / 40) AS BIGINT) AS doc_id, CAST(floor(k / 10) AS BIGINT) % 4 AS page_index, k % 10 AS line_id, {seq} AS token_seq,
           {text} AS text, CAST({x} AS DOUBLE) AS x, CAST((k % 10) * 30 AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, CAST({h} AS DOUBLE) AS h,
           CAST(1 - (k % 4) * 0.125 AS DOUBLE) AS confidence
    FROM ids WHERE {where}"""


_PAN = f"concat({_letter('k')}, {_letter('k * 7')}, {_letter('k * 3')}, substr('PFCHATBLJGXZQ', CAST(k % 13 + 1 AS INT), 1), {_letter('k * 5')}, lpad(CAST(k % 10000 AS STRING), 4, '0'), {_letter('k * 11')})"
_PARTS = [
    *(_token(i, f"substr(id, {4 * i + 1}, 4)", f"{20 + 60 * i}", "40", "20", "k % 8 IN (0, 5)") for i in range(3)),
    _token(3, "id", "150", "160", "20", "k % 16 = 0"),
    _token(0, "concat(substr(id, 1, 4), ' ', substr(id, 5, 4), ' ', substr(id, 9, 4))", "20", "140", "20", "k % 8 = 1"),
    _token(0, "concat('No:', substr(id, 1, 4), '-', substr(id, 5, 4), '-', substr(id, 9, 4))", "20", "170", "20", "k % 8 = 2"),
    _token(0, "id", "20", "120", "20", "k % 8 = 3"),
    _token(0, "id", "20", "730", "44", "k % 8 = 4"),
    _token(1, "id", "600", "120", "20", "k % 16 = 4"),
    _token(0, _PAN, "20", "100", "20", "k % 8 IN (6, 7)"),
]


def _mrz(line: int, seq: int, text: str, x: int, w: int) -> str:
    return f"""
    SELECT CAST(floor(c_custkey / 4) AS BIGINT), c_custkey % 4, CAST({line} AS BIGINT), {seq}, {text}, CAST({x} AS DOUBLE), CAST({3 * line} AS DOUBLE),
           CAST({w} AS DOUBLE), CAST(20 AS DOUBLE), CAST(0.75 AS DOUBLE) FROM customer"""


_NAME = "rpad(concat('NAME<<', chr(CAST(65 + c_custkey % 26 AS INT)), chr(CAST(65 + c_nationkey % 26 AS INT))), 39, '<')"
_SECOND = "concat(lpad(CAST(c_custkey AS STRING), 9, '0'), CASE WHEN c_custkey % 3 = 0 THEN '<' ELSE '7' END, CASE WHEN c_custkey % 5 = 0 THEN 'USA' ELSE 'IND' END, '8001011M3001011<<<<<<<<<<<<<<02')"
_PARTS += [_mrz(100, 1, _NAME, 80, 390), _mrz(100, 0, "'p<ind'", 20, 50), _mrz(102, 0, _SECOND, 20, 440)]

_PAGES = """
    SELECT doc_id, page_index, CAST(800 + (doc_id % 5) * 100 AS BIGINT) AS width, CAST(400 + (doc_id % 3) * 100 AS BIGINT) AS height,
           CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'image' END AS kind, CAST((800 + (doc_id % 5) * 100) * 0.75 AS DOUBLE) AS width_pt,
           CAST((400 + (doc_id % 3) * 100) * 0.75 AS DOUBLE) AS height_pt, (doc_id * 7 + page_index) % 900 AS elapsed_ms
    FROM (SELECT DISTINCT doc_id, page_index FROM tokens) AS p
"""

#: Boxes of one face by two models, a shifted second one, and null boxes.
_FACES = """
    SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS doc_id, CAST(floor(p_partkey / 2) AS BIGINT) % 4 AS page_index,
           CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'short' END AS model,
           CASE WHEN p_partkey % 50 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((floor(p_partkey / 2) * 37) % 400 + (p_partkey % 2) * (p_partkey % 7) * 8 - 4.25 AS DOUBLE) END AS origin_x,
           CAST((floor(p_partkey / 2) * 53) % 200 + 0.5 AS DOUBLE) AS origin_y, CAST(60 + p_partkey % 3 AS DOUBLE) AS width, CAST(80 AS DOUBLE) AS height,
           CAST((p_partkey * 5 % 64) / 64.0 AS DOUBLE) AS score
    FROM part
"""

_CODES = """
    SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, doc_id % 4 AS page_index, CASE WHEN doc_id % 2 = 0 THEN 'native' ELSE 'second' END AS source,
           CAST(doc_id % 2 AS INT) AS priority, text AS payload, CAST((doc_id * 13) % 300 AS DOUBLE) AS qx, CAST((doc_id * 29) % 200 AS DOUBLE) AS qy,
           CAST(40 + doc_id % 8 AS DOUBLE) AS qw, doc_id % 11 = 0 AS lost
    FROM documents
"""

_MANIFEST = """
    SELECT o_orderkey AS doc_id,
           concat(CASE WHEN o_orderkey % 9 = 0 THEN '.' ELSE 'scan ' END, CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.v2.png' WHEN 3 THEN '.webp' WHEN 4 THEN '.heic' ELSE '' END) AS name,
           CASE o_orderkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN '' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'image/png' ELSE 'image/heic' END AS mime,
           CAST(floor(o_totalprice * 100) AS BIGINT) AS size, CAST(o_orderkey % 13 AS INT) AS num_pages
    FROM orders
"""

#: Pages of 48 x 48, as many as 2,304 order keys go into; most are dense, so that windows of neighbours are whole.
_PIXELS = """
    SELECT page_id, px, py, r, g, b, 255 AS a FROM (
        SELECT CAST(floor(l_orderkey / 2304) AS BIGINT) AS page_id, CAST(l_orderkey % 48 AS INT) AS px, CAST(floor(l_orderkey / 48) AS BIGINT) % 48 AS py,
               max(CAST(l_partkey % 256 AS INT)) AS r, max(CAST(l_suppkey * 7 % 256 AS INT)) AS g, max(CAST(l_orderkey % 256 AS INT)) AS b
        FROM lineitem GROUP BY 1, 2, 3) AS p
"""

_INTAKE = """
    SELECT event_id, ts, CASE WHEN user_id % 37 = 0 THEN '' ELSE concat('10.0.0.', CAST(user_id % 29 AS STRING)) END AS ip,
           CASE WHEN event_id % 17 = 0 THEN 'https://elsewhere.example' ELSE 'https://site.example' END AS origin,
           CASE WHEN event_id % 19 = 0 THEN 'GET' WHEN event_id % 23 = 0 THEN 'OPTIONS' ELSE 'POST' END AS method,
           CASE WHEN event_id % 29 = 0 THEN 'text/plain' ELSE 'Application/JSON; charset=utf-8' END AS content_type,
           concat('{"email":" u', CAST(user_id AS STRING), CASE WHEN event_id % 7 = 0 THEN '' ELSE '@mail' END, '.example ","company":"',
                  CASE WHEN event_id % 11 = 0 THEN 'X' WHEN event_id % 31 = 0 THEN repeat('c', 5000) ELSE 'Company' END, '","useCase":"',
                  CASE WHEN event_id % 13 = 0 THEN 'Fun' ELSE 'Insurance' END, '"', CASE WHEN event_id % 41 = 0 THEN ',"extra":1' ELSE '' END, '}') AS body
    FROM events
"""

TABLES = {"ids": _IDS, "tokens": " UNION ALL ".join(_PARTS), "pages": _PAGES, "faces": _FACES, "codes": _CODES, "manifest": _MANIFEST, "pixels": _PIXELS, "intake": _INTAKE}
NEEDS = {"ids": ["orders"], "tokens": ["ids", "customer"], "pages": ["tokens"], "faces": ["part"], "codes": ["documents"], "manifest": ["orders"], "pixels": ["lineitem"], "intake": ["events"]}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table from the given tables."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("ids", "tokens", "pages"):  # written once, as recognised tokens would be; else their arithmetic is planned again in each use
        return written_once(spark, f"derived-{name}", sf_dir, lambda: _planned(spark, sf_dir, name))
    return _planned(spark, sf_dir, name)


def _planned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, views = TABLES[name], {}
    for n in NEEDS[name]:
        views[n] = derived(spark, sf_dir, n)
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text.replace("'{\"email", "'{{\"email").replace("'}')", "'}}')"), **views)


def ctes(*names: str) -> str:
    """WITH clause of derived tables, in order, for DuckDB. The pages of documents are called pages_ there."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES and name not in order:
            for n in NEEDS[name]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n}{'_' if n == 'pages' else ''} AS ({TABLES[n]})" for n in order)


def codes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw code hits with four corners, or none where the position was lost."""
    rows = derived(spark, sf_dir, "codes")
    corner = lambda dx, dy: F.struct((F.col("qx") + dx).alias("x"), (F.col("qy") + dy).alias("y"))
    w = F.col("qw")
    quad = F.struct(corner(0, 0).alias("tl"), corner(w, 0).alias("tr"), corner(0, w).alias("bl"), corner(w, w).alias("br"))
    return rows.select("doc_id", "page_index", "source", "priority", "payload", F.when(~F.col("lost"), quad).alias("position"))
