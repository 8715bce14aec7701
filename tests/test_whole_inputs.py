"""Queries that must take their whole table, and not a share of it."""

import duckdb

from veilwork.functions.checksum import fold
from veilwork.plans import more  # noqa: F401
from veilwork.plans.fixtures import derived
from veilwork.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for t in "orders lineitem documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_native_fold_judges_every_id(spark):
    ids = derived(spark, SF, "ids").collect()
    c, digits = fold([r.id for r in ids], 0)
    want = {r.k: bool(ok and x == 0) for r, x, ok in zip(ids, c, digits, strict=True)}
    assert {r.k: r.valid for r in QUERIES["verhoeff_valid_fold"](spark, SF).collect()} == want and len(want) == 1500
    assert dict(connect().sql(ORACLE_SQL["verhoeff_valid_fold"]).fetchall()) == want


def test_whole_texts_are_masked(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["mask_text"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(len(r.masked) > len(docs[r.doc_id]) + 100 for r in rows)
    assert max(r.n_masked for r in rows) == 3


def test_pixels_grow_with_the_table(spark):
    small, large = (derived(spark, f"/root/testdata/{sf}", "pixels").count() for sf in ("sf0.001", "sf0.01"))
    assert large >= 8 * small
    assert derived(spark, "/root/testdata/sf0.01", "pixels").select("page_id").distinct().count() == 7
