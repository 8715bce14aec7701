"""Tiled rasters against whole ones in numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.operators import raster, tiles

RASTER = "page_id long, width int, height int, rgba binary"


def image(width, height, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4), np.uint8)


def luminance(a):
    return np.floor(0.299 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.114 * a[:, :, 2] + 0.5).astype(np.int64)


def blurred(v):
    out = v.copy()
    total = sum((2 - abs(i)) * (2 - abs(j)) * v[1 + i : v.shape[0] - 1 + i, 1 + j : v.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    out[1:-1, 1:-1] = (total + 8) // 16
    return out


def whole(rows, width, height, channel="r"):
    out = np.full((height, width), -1)
    for r in tiles.to_pixels(rows).collect():
        out[r.py, r.px] = r[channel]
    return out


def test_cut_blur_rotate_and_crop(spark):
    width, height = 37, 23
    a = image(width, height)
    df = spark.createDataFrame([(1, width, height, bytearray(a.tobytes())), (2, 1, 1, bytearray(4))], RASTER)
    t = tiles.cut(df, 8).cache()
    one = t.where("page_id = 1")
    assert (whole(one, width, height, "g") == a[:, :, 1]).all()
    v = luminance(a)
    assert (whole(tiles.blur(tiles.gray(one)), width, height) == blurred(v)).all()
    for rotation, turns in ((90, 3), (180, 2), (270, 1)):
        turned = tiles.rotate(tiles.gray(one), rotation)
        want = np.rot90(v, turns)
        assert (whole(turned, want.shape[1], want.shape[0]) == want).all()
        # Borders turn with their tile, so what is blurred later sees the same neighbours.
        assert (whole(tiles.blur(turned), want.shape[1], want.shape[0]) == blurred(want)).all()
    cropped = tiles.crop(tiles.gray(one), 5, 18)
    assert (whole(cropped, width, 13) == v[5:18]).all()
    assert {(r.page_w, r.page_h) for r in cropped.collect()} == {(width, 13)}
    assert tiles.to_pixels(tiles.blur(tiles.gray(t.where("page_id = 2")))).count() == 1
    with pytest.raises(Exception, match="no border left"):
        tiles.blur(cropped).count()


def test_painted_tiles_have_painted_borders(spark):
    width, height = 30, 20
    a = image(width, height, 3)
    t = tiles.cut(spark.createDataFrame([(1, width, height, bytearray(a.tobytes()))], RASTER), 8)
    masks = spark.createDataFrame([(1, 6.5, 3.0, 4.0, 9.5), (1, -3.0, 15.0, 5.0, 100.0), (1, 12.0, 2.0, 0.0, 5.0), (9, 0.0, 0.0, 50.0, 50.0)], "page_id long, x double, y double, w double, h double")
    want = a.copy()
    want[3:13, 6:11] = want[15:, :2] = (0, 0, 0, 255)
    painted = tiles.paint(t, masks, 8)
    for i, c in enumerate("rgba"):
        assert (whole(painted, width, height, c) == want[:, :, i]).all()
    assert (whole(tiles.blur(tiles.gray(painted)), width, height) == blurred(luminance(want))).all()


def test_no_tiles(spark):
    empty = spark.createDataFrame([], "page_id long, px int, py int, r int, g int, b int, a int")
    assert tiles.to_pixels(tiles.enhance(tiles.from_pixels(empty), threshold=True)).count() == 0
    assert tiles.cell_stats(tiles.from_pixels(empty)).count() == 0


def test_a_page_of_28_million_pixels_runs_in_bounded_rows(spark):
    width, height = 7000, 4000

    def pages(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                data = np.random.default_rng(i).integers(0, 256, (height, width, 4), np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([data])], ["page_id", "width", "height", "rgba"])

    t = tiles.cut(spark.range(1, 2, 1, 1).mapInArrow(pages, RASTER))
    sizes = t.select("page_id", F.length("data").alias("n")).groupBy("page_id").agg(F.count("*").alias("tiles"), F.max("n").alias("most")).first()
    assert sizes.tiles == -(-width // 256) * -(-height // 256) and sizes.most <= 258 * 258 * 5
    v = luminance(image(width, height, 1))
    found = {r.v: r.n for r in tiles.histogram(tiles.gray(t)).collect()}
    assert found == {i: int(n) for i, n in enumerate(np.bincount(v.ravel(), minlength=256)) if n}
    want = blurred(v)
    some = tiles.blur(tiles.gray(t.where("x0 IN (0, 2560, 6912) AND y0 IN (0, 1280, 3840)"))).collect()
    assert len(some) == 9
    for r in some:
        got = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 5)[:, :, 0]
        assert (got == want[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]).all()


def test_masks_by_row_meet_one_scan_of_pixels(spark, tmp_path):
    rows = [(p, x, y, x, y, 9, 255) for p in (1, 2) for x in range(12) for y in range(9)]
    spark.createDataFrame(rows, "page_id long, px int, py int, r int, g int, b int, a int").write.parquet(str(tmp_path / "pixels"))
    pixels = spark.read.parquet(str(tmp_path / "pixels"))
    masks = spark.createDataFrame([(1, 2.5, 1.0, 3.0, 2.25), (1, 4.0, 0.0, 2.0, 20.0), (2, 0.0, 0.0, 0.0, 5.0)], "page_id long, x double, y double, w double, h double")
    out = raster.paint_masks(pixels, masks)
    black = lambda x, y: (2 <= x < 6 and 1 <= y < 4) or 4 <= x < 6
    assert sorted(map(tuple, out.collect())) == sorted((p, x, y, *((0, 0, 0, 255) if p == 1 and black(x, y) else (x, y, 9, 255))) for p, x, y, *_ in rows)
    plan = raster.paint_masks(pixels, masks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "NestedLoop" not in plan


def test_a_worker_takes_up_few_tiles_at_once():
    whole = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "data": [b"x"] * 100})
    taken = list(tiles._few(iter([whole, whole.slice(0, 0), whole.slice(0, 5)])))
    assert max(b.num_rows for b in taken) <= tiles.BATCH
    assert [i for b in taken for i in b.column("page_id").to_pylist()] == [*range(100), *range(5)]
