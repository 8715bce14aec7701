"""Manifests read from files and written in partitions, session tables, coverage of faces."""

import os
import random

import pytest
from pyspark.sql import functions as F

from veilwork.functions import geometry as G
from veilwork.functions.text import mask_text
from veilwork.operators import detect, review
from veilwork.sources import admission, export

LINE1, LINE2 = "P<INDNAME<<ANN".ljust(44, "<"), "0000001017IND8001011M3001011<<<<<<<<<<<<<<02"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_of_files_reads_no_contents(spark, tmp_path):
    for name, n in (("a.pdf", 10), ("deep/b.PNG", 1), ("deep/c.heic", 5)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * n)
    found = admission.read_manifest(spark, str(tmp_path))
    assert sorted((r.name, r["size"], r.mime) for r in found.collect()) == [("a.pdf", 10, ""), ("b.PNG", 1, ""), ("c.heic", 5, "")]
    admitted = admission.admit_files(found)
    assert {r.name: r.reason for r in admitted.collect()} == {"a.pdf": None, "b.PNG": None, "c.heic": "unsupported_type"}
    scan = next(line for line in plan_of(found).splitlines() if "FileScan binaryFile" in line)
    assert "content" not in scan.split("ReadSchema")[1]


def test_manifest_in_partitions_is_read_pruned(spark, tmp_path):
    rows = [(d, 0, "pdf" if d % 3 == 0 else "image", 100.0, 50.0, [(1.0, 2.0, 3.0, 4.0)] * (d % 2)) for d in range(12)]
    manifest = spark.createDataFrame(rows, f"doc_id long, page_index long, kind string, width_pt double, height_pt double, masks array<{G.BOX}>")
    path = str(tmp_path / "manifest")
    for _ in range(2):  # what is written again replaces
        export.write_manifest(manifest, path)
    assert {n for n in os.listdir(path) if n.startswith("kind=")} == {"kind=pdf", "kind=image"}
    pdf = spark.read.parquet(path).where("kind = 'pdf'").select("doc_id", F.size("masks").alias("n"))
    assert sorted(map(tuple, pdf.collect())) == [(d, d % 2) for d in range(0, 12, 3)]
    plan = plan_of(pdf)
    assert "PartitionFilters: [isnotnull(kind" in plan and "width_pt" not in plan.split("ReadSchema")[1]


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_touches_only_partitions_with_seeds(spark, tmp_path):
    path, box = str(tmp_path / "sessions"), lambda n: [(float(n), 0.0, 1.0, 1.0)]
    kinds = f"doc_id long, dirty boolean, boxes array<{G.BOX}>"
    sessions = spark.createDataFrame([(i, i % 2 == 1, box(i)) for i in range(40)], kinds)
    review.write_sessions(sessions, path, parts=8)
    seeds = spark.createDataFrame([(i, box(100 + i), r) for i, r in ((2, None), (3, None), (5, "replace"), (7, "keep"), (90, None))], f"doc_id long, boxes array<{G.BOX}>, resolution string")
    before = files(path)
    review.upsert_handoff(path, seeds, parts=8)
    table = lambda: {r.doc_id: (r.dirty, r.boxes[0].x, r.pending[0].x if r.pending else None) for r in spark.read.parquet(path).collect()}
    after = table()
    want = {i: (i % 2 == 1, float(i), None) for i in range(40)} | {2: (False, 102.0, None), 3: (True, 3.0, 103.0), 5: (False, 105.0, None), 7: (True, 7.0, None), 90: (False, 190.0, None)}
    assert after == want
    touched = {f"part={r.part}" for r in seeds.select((F.pmod(F.xxhash64("doc_id"), F.lit(8))).alias("part")).collect()}
    stayed = {f: t for f, t in before.items() if f.split(os.sep)[-2] not in touched}
    assert stayed and all(files(path).get(f) == t for f, t in stayed.items())
    review.upsert_handoff(path, seeds, parts=8)
    assert table() == want
    # A decision on boxes that wait needs no new seeds.
    review.upsert_handoff(path, spark.createDataFrame([(3, None, "replace")], seeds.schema), parts=8)
    assert table()[3] == (False, 103.0, None)
    review.upsert_handoff(path, seeds.limit(0), parts=8)
    assert len(table()) == 41


def test_coverage_by_strips_against_columns(spark):
    rnd = random.Random(9)
    number = lambda top: rnd.randrange(4 * top) / 4
    faces = [(1, p, (number(30), number(30), number(40) + (p > 0), number(30) + (p > 0))) for p in range(12)]
    tokens = [(1, rnd.randrange(12), number(60), number(60), number(30), number(20)) for _ in range(90)]

    def share(f, boxes):
        x, y, w, h = f
        total, k = 0.0, 0
        while x + k < x + w:
            spans = sorted((max(y, b[1]), min(y + h, b[1] + b[3])) for b in boxes if b[0] <= x + k < b[0] + b[2] and b[0] < x + w and b[0] + b[2] > x and b[1] < y + h and b[1] + b[3] > y)
            top = -1e9
            for a, b in spans:
                total += max(0.0, b - max(a, top))
                top = max(top, b)
            k += 1
        return total / (w * h) if w * h > 0 else 0.0

    f = spark.createDataFrame([(d, p, b, 0.9) for d, p, b in faces], f"doc_id long, page_index long, bbox {G.BOX}, confidence double")
    t = spark.createDataFrame(tokens, "doc_id long, page_index long, x double, y double, w double, h double")
    got = {r.page_index: r.coverage for r in detect.text_coverage(f, t).collect()}
    want = {p: share(b, [x[2:] for x in tokens if x[1] == p]) for _, p, b in faces}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and sum(v > 0 for v in want.values()) > 4


def test_code_regions_end_with_the_page(spark):
    cells = [(1, 0, r, c, 10, r < 5 and 7 <= c, r < 5 and 7 <= c, False) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(cells, "doc_id long, page_index long, row long, col long, cell int, textured boolean, bimodal boolean, has_text boolean")
    pages = spark.createDataFrame([(1, 0, 115, 120)], "doc_id long, page_index long, width long, height long")
    faces = spark.createDataFrame([], f"doc_id long, page_index long, bbox {G.BOX}")
    assert [(tuple(r.bbox), r.value) for r in detect.locate_qr_cells(df, pages, faces).collect()] == [((70.0, 0.0, 45.0, 50.0), "visual-qr-candidate")]


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", " ", " ", "\x85", "\x0b", "\x0c", "\n \t\n", "\r "])
def test_passport_lines_are_hidden_whatever_parts_them(spark, end):
    text = f"a{end}{LINE1}{end}{LINE2}{end}b"
    row = mask_text(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.masked, row.n_masked) == (f"a{end}{'X' * 44}{end}{'X' * 44}{end}b", 1)


def test_input_errors_pass_through(spark):
    df = spark.createDataFrame([("Use a file up to 20 MB; this exceeds it.", True), ("file exceeds all", False), ("file exceeds all", None)], "m string, typed boolean")
    assert [r.c for r in df.select(admission.classify_failure(F.col("m"), F.col("typed")).alias("c")).collect()] == ["Use a file up to 20 MB; this exceeds it.", "too_large", "too_large"]


def test_written_tables_are_removed_together(spark, tmp_path, monkeypatch):
    from veilwork.sources import staging

    monkeypatch.setattr(staging, "_PATHS", [])
    monkeypatch.setattr(staging, "_WRITTEN", {})
    one = staging.written(spark.range(3), "one")
    two = staging.written_once(spark, "two", "sf", lambda: spark.range(4))
    folders = [df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for df in (one, two)]
    assert all(map(os.path.isdir, folders)) and (one.count(), two.count()) == (3, 4)
    assert staging.remove_written(spark) == 2 and not any(map(os.path.exists, folders))
    assert staging.written_once(spark, "two", "sf", lambda: spark.range(5)).count() == 5
