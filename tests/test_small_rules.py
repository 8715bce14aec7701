"""Box edits, components, code regions, rasters and geometry against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from veilwork.functions import geometry as G
from veilwork.operators import detect, raster, review


def within(v, top):
    return max(0.0, min(v, top))


def fold(box, edits, w, h):
    """The rules of an edit, one after the other, on (x, y, width, height)."""
    for _, op, handle, x1, y1, x2, y2 in sorted(edits):
        if op == "draw" and abs(x2 - x1) >= 4 and abs(y2 - y1) >= 4:
            box = (within(min(x1, x2), w), within(min(y1, y2), h), within(abs(x2 - x1), w), within(abs(y2 - y1), h))
        elif op == "delete":
            box = None
        elif box and op == "move":
            box = (within(box[0] + x1, w - box[2]), within(box[1] + y1, h - box[3]), box[2], box[3])
        elif box and op == "resize":
            left, right = x1 if "w" in handle else box[0], x1 if "e" in handle else box[0] + box[2]
            top, bottom = y1 if "n" in handle else box[1], y1 if "s" in handle else box[1] + box[3]
            x, y = within(min(left, right), w), within(min(top, bottom), h)
            box = (x, y, min(abs(right - left), w - x), min(abs(bottom - top), h - y))
    return box


def test_box_edits_over_seeds(spark):
    rnd = random.Random(3)
    ids = [(d, f"{kind}{n}") for d in range(12) for kind, n in (("auto-", 0), ("auto-", 1), ("b", 0))]
    seeds = {k: tuple(float(rnd.randrange(1, 90)) for _ in range(4)) for k in ids if k[1].startswith("auto") and rnd.random() < 0.8}
    edits, seq = {}, 0
    for k in ids:
        for _ in range(rnd.randrange(5)):
            seq += 1
            edits.setdefault(k, []).append((seq, rnd.choice(["draw", "move", "move", "resize", "resize", "delete"]), rnd.choice(["n", "s", "e", "w", "ne", "nw", "se", "sw"]), *(float(rnd.randrange(-60, 260)) for _ in range(4))))
    s = spark.createDataFrame([(d, 0, b, v) for (d, b), v in seeds.items()], f"doc_id long, page_index long, box_id string, box {G.BOX}")
    names = [c.split(":") for c in review.EDIT[7:-1].split(",")]
    e = spark.createDataFrame([(d, 0, b, *row) for (d, b), rows in edits.items() for row in rows], "doc_id long, page_index long, box_id string, edit_seq long, op string, handle string, x1 double, y1 double, x2 double, y2 double")
    assert {n.strip() for n, _ in names} == set(e.columns[3:])
    pages = spark.createDataFrame([(d, 0, 200, 150) for d in range(12)], "doc_id long, page_index long, width long, height long")
    got = {(r.doc_id, r.box_id): tuple(r.box) for r in review.fold_box_edits(s, e.repartition(5), pages).collect()}
    want = {k: fold(seeds.get(k), edits.get(k, []), 200.0, 150.0) for k in ids}
    assert got == {k: v for k, v in want.items() if v}


def test_counts_write_no_detections(spark):
    from veilwork.plans.queries import QUERIES
    from veilwork.sources import staging

    before = len(staging._PATHS)
    assert QUERIES["accuracy_totals"](spark, "/root/testdata/sf0.001").collect()[0].samples > 0
    assert not [p for p in staging._PATHS[before:] if "veilwork-detections" in p]


def test_brief_detections_have_the_same_index(spark):
    """Codes at one corner go by their payload; without payloads their ordinal keeps that order. No payload is left to move to the page's order."""
    tokens = spark.createDataFrame([(1, 0, 0, 0, "ABCPE1234F", 5.0, 5.0, 90.0, 20.0, 0.9)], "doc_id long, page_index long, line_id long, token_seq int, text string, x double, y double, w double, h double, confidence double")
    face = spark.createDataFrame([(1, 0, "face", (9.0, 1.0, 5.0, 5.0), (9.0, 1.0, 5.0, 5.0), "face", 0.9, False)], f"doc_id long, page_index long, kind string, bbox {G.BOX}, mask_bbox {G.BOX}, value string, confidence double, suspicious boolean")
    # Boxes so unlike in size that they stay beside one another.
    codes = [(1, 0, "other_qr", (7.0, 7.0, w, w), (7.0, 7.0, w, w), v, 1.0, False, 0) for v, w in (("payload b", 10.0), ("payload c", 40.0), ("payload a", 160.0))]
    codes = detect.compose_qr(spark.createDataFrame(codes, f"doc_id long, page_index long, kind string, bbox {G.BOX}, mask_bbox {G.BOX}, value string, confidence double, suspicious boolean, priority int"))
    whole, brief = detect.detect_page(tokens, face, codes), detect.detect_page_brief(tokens, face, codes)
    rows = sorted((r.detection_index, r.kind, r.value, r.bbox.w) for r in whole.collect())
    assert [(i, v) for i, _, v, _ in rows] == [(0, "ABCPE1234F"), (1, "face"), (2, "payload a"), (3, "payload b"), (4, "payload c")]
    assert sorted((r.detection_index, r.kind, r.bbox.w) for r in brief.collect()) == [(i, k, w) for i, k, _, w in rows] and "value" not in brief.columns


def components(cells):
    """Sizes and edges of 4-neighbour components by repeated relabelling."""
    label = {c: c for c in cells}
    changed = True
    while changed:
        changed = False
        for r, c in cells:
            low = min(label[n] for n in ((r, c), (r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if n in label)
            changed, label[r, c] = changed or low != label[r, c], low
    groups = {}
    for c, name in label.items():
        groups.setdefault(name, []).append(c)
    return sorted((min(r for r, _ in g), max(r for r, _ in g), min(c for _, c in g), max(c for _, c in g), len(g), sum(cells[k] for k in g)) for g in groups.values())


CELL = "doc_id long, page_index long, row long, col long, cell int, textured boolean, bimodal boolean, has_text boolean"


def test_components_of_random_grids(spark):
    rnd = random.Random(8)
    grids = {d: {(r, c): rnd.random() < 0.5 for r in range(9) for c in range(9) if rnd.random() < 0.55} for d in range(6)}
    df = spark.createDataFrame([(d, 0, r, c, 10, True, b, False) for d, cells in grids.items() for (r, c), b in cells.items()], CELL)
    rows = detect.grid_components(df.repartition(3)).collect()
    for d, cells in grids.items():
        assert sorted((r.row1, r.row2, r.col1, r.col2, r.cells, r.bimodal_cells) for r in rows if r.doc_id == d) == components(cells)
    assert detect.grid_components(df.limit(0)).count() == 0


def test_code_regions(spark):
    # On pages of 200 x 200: a square of bimodal cells, on page 1 under a face, on 2 with text, on 3 too long.
    square = [(r, c) for r in (2, 3, 4) for c in (5, 6, 7)]
    rows = [(0, p, r, c, 10, False, True, p == 2) for p in (0, 1, 2) for r, c in square] + [(0, 3, 2, c, 10, True, True, False) for c in range(9)]
    pages = spark.createDataFrame([(0, p, 200, 200) for p in range(4)], "doc_id long, page_index long, width long, height long")
    faces = spark.createDataFrame([(0, 1, (50.0, 20.0, 30.0, 15.0)), (0, 0, (50.0, 20.0, 30.0, 11.0))], f"doc_id long, page_index long, bbox {G.BOX}")
    out = detect.locate_qr_cells(spark.createDataFrame(rows, CELL), pages, faces).collect()
    assert [(r.page_index, r.kind, tuple(r.bbox)) for r in out] == [(0, "other_qr", (50.0, 20.0, 30.0, 30.0))]


def test_enhanced_pixels(spark):
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (7, 9, 3))
    rows = [(1, x, y, *map(int, rgb[y, x]), 255) for y in range(7) for x in range(9)]
    out = raster.enhance(spark.createDataFrame(rows, "page_id long, px int, py int, r int, g int, b int, a int"))
    gray = np.floor(rgb @ [0.299, 0.587, 0.114] + 0.5).astype(int)
    soft = gray.copy()
    for y in range(1, 6):
        for x in range(1, 8):
            soft[y, x] = int(np.floor((gray[y - 1 : y + 2, x - 1 : x + 2] * np.outer([1, 2, 1], [1, 2, 1])).sum() / 16 + 0.5))
    hist = np.bincount(soft.ravel(), minlength=256)
    limit = max(1, int(63 * raster.CLIP))
    cdf = np.cumsum(np.minimum(hist, limit) + np.maximum(hist - limit, 0).sum() // 256)
    low = cdf[cdf > 0][0]
    lut = np.clip(np.floor((cdf - low) / ((63 - low) or 1) * 255 + 0.5), 0, 255).astype(int)
    assert {(r.px, r.py): r.r for r in out.collect()} == {(x, y): int(lut[soft[y, x]]) for y in range(7) for x in range(9)}


def test_cells_that_a_token_touches(spark):
    pixels = spark.createDataFrame([(1, x, y, 9, 9, 9) for x in range(48) for y in range(48)], "page_id long, px int, py int, r int, g int, b int")
    boxes = spark.createDataFrame([(1, 9.0, 10.0, 7.0, 3.0)], "page_id long, x double, y double, w double, h double")
    rows = raster.cell_stats(pixels, boxes).collect()
    size = rows[0].cell
    want = {(r, c) for r in range(48 // size) for c in range(48 // size) if 10 // size <= r <= 13 // size and 9 // size <= c <= 16 // size}
    assert {(r.row, r.col) for r in rows if r.has_text} == want


def test_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    b = G.box(*lit(10, 20, 30, 40))
    row = spark.range(1).select(
        G.overlap_fraction(b, G.box(*lit(25, 20, 30, 10))).alias("share"), G.normalize_box(*lit(9, 8, 2, 30)).alias("corners"),
        G.clamp_move(G.box(*lit(-5, 90, 30, 40)), *lit(100, 100)).alias("move"), G.clamp_resize(G.box(*lit(90, -1, 30, 400)), *lit(100, 100)).alias("resize"),
        G.resize_by_handle(b, F.lit("nw"), *lit(50, 5)).alias("handle"), G.point_in_box(*lit(40, 60), b).alias("edge"), G.point_in_box(*lit(40.5, 60), b).alias("out"),
        G.fit_within(F.lit(4800), F.lit(1000)).alias("fit"), G.fit_within(F.lit(2400), F.lit(10)).alias("fits"),
        G.rotated_dims(F.lit(3), F.lit(5), F.lit(270)).alias("turned"), G.rotated_dims(F.lit(3), F.lit(5), F.lit(180)).alias("upside"),
    ).first()
    assert row.share == 0.125 and tuple(row.corners) == (2, 8, 7, 22)
    assert tuple(row.move) == (0, 60, 30, 40) and tuple(row.resize) == (90, 0, 10, 100) and tuple(row.handle) == (40, 5, 10, 55)
    assert row.edge and not row.out
    assert tuple(row.fit) == (2400, 500, 0.5) and tuple(row.fits) == (2400, 10, 1.0)
    assert tuple(row.turned) == (5, 3) and tuple(row.upside) == (3, 5)
