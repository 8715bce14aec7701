"""Rasters as tiles: rows of a small rectangle's pixels, worked with numpy, so that no task holds a page.

A tile has page_id, page_w, page_h, x0, y0, w, h (its rectangle on the page), halo (0 or 1, the border of neighbouring pixels that its data has
besides) and data: (h + 2 * halo) x (w + 2 * halo) pixels, row by row, of five bytes: r, g, b, a and whether the pixel is there, 0 or 1. What
lies beyond the page, or was never given, is not there. Tiles are SIZE pixels wide and high at most, so a row has a bounded size
whatever the page; what a page is told, its threshold or tones, meets its tiles over SPREAD keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.operators.raster import CLIP, DARK, GRID, LEAST_CELL, LIGHT, TEXTURE, thresholds_of, tones_of
from veilwork.operators.raster import BIMODAL as EXTREME

SIZE, CHANNELS, SPREAD = 256, 5, 16
KEY = ["page_id", "x0", "y0"]
#: Tiles that a worker takes up, or a cut page gives out, at once, whatever the size of Arrow's batches.
BATCH = 32

Frame = dict[str, int]
Work = Callable[[np.ndarray, Frame], tuple[np.ndarray, Frame]]


def _schema(kind: T.DataType) -> T.StructType:
    whole = [T.StructField(c, T.IntegerType()) for c in ("page_w", "page_h", "x0", "y0", "w", "h", "halo")]
    return T.StructType([T.StructField("page_id", kind), *whole, T.StructField("data", T.BinaryType())])


def _array(frame: Frame, data: bytes) -> np.ndarray:
    edge = 2 * frame["halo"]
    return np.frombuffer(data, np.uint8).reshape(frame["h"] + edge, frame["w"] + edge, CHANNELS)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BATCH tiles at most."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def _inner(pixels: np.ndarray, frame: Frame) -> np.ndarray:
    k = frame["halo"]
    return pixels[k : k + frame["h"], k : k + frame["w"]]


def _each(tiles: DataFrame, work: Work, more: tuple[str, ...] = ()) -> DataFrame:
    """Tiles after work on each (its pixels and frame, with the columns `more` in it)."""
    schema = _schema(tiles.schema["page_id"].dataType)
    names = schema.names[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            frames = b.select([*names, *more]).to_pylist()
            done = [work(_array(f, d.as_py()), f) for f, d in zip(frames, b.column("data"), strict=True)]
            columns = [b.column("page_id"), *(pa.array([f[c] for _, f in done], pa.int32()) for c in names), pa.array([p.tobytes() for p, _ in done], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return tiles.select(*schema.names, *more).mapInArrow(run, schema)


def from_pixels(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of a pixel table (page_id, px, py, r, g, b, a). A pixel goes to its tile and to the borders of those beside it; a group is one tile."""
    pages = pixels.groupBy("page_id").agg((F.max("px") + 1).cast("int").alias("page_w"), (F.max("py") + 1).cast("int").alias("page_h"))
    near = lambda c, top: F.filter(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / size).cast("int") for d in (-1, 0, 1)))), lambda t: (t >= 0) & (t * size < F.col(top)))
    at = pixels.join(pages, "page_id")
    at = at.withColumn("tx", F.explode(near("px", "page_w"))).withColumn("ty", F.explode(near("py", "page_h")))
    at = at.select("page_id", "page_w", "page_h", "tx", "ty", *(F.col(c).cast("int").alias(c) for c in ("px", "py", "r", "g", "b", "a")))
    schema = _schema(pixels.schema["page_id"].dataType)

    def tile(rows: pa.Table) -> pa.Table:
        first = {c: rows.column(c)[0].as_py() for c in ("page_w", "page_h", "tx", "ty")}
        x0, y0 = first["tx"] * size, first["ty"] * size
        w, h = min(size, first["page_w"] - x0), min(size, first["page_h"] - y0)
        out = np.zeros((h + 2, w + 2, CHANNELS), np.uint8)
        x, y = rows.column("px").to_numpy() - x0 + 1, rows.column("py").to_numpy() - y0 + 1
        keep = (x < w + 2) & (y < h + 2)
        for i, c in enumerate("rgba"):
            out[y[keep], x[keep], i] = rows.column(c).to_numpy()[keep]
        out[y[keep], x[keep], 4] = 1
        values = [rows.column("page_id")[:1].combine_chunks(), *(pa.array([v], pa.int32()) for v in (first["page_w"], first["page_h"], x0, y0, w, h, 1)), pa.array([out.tobytes()], pa.binary())]
        return pa.Table.from_arrays(values, schema.names)

    return at.groupBy("page_id", "tx", "ty").applyInArrow(tile, schema)


def cut(rasters: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of whole rasters: page_id, width, height and rgba, four bytes a pixel, row by row. A row is cut where it is read; pages that admission lets in fit."""
    schema = _schema(rasters.schema["page_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field("page_id").type
            for page, width, height, rgba in zip(b.column("page_id"), b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("rgba"), strict=True):
                image = np.frombuffer(rgba.as_buffer(), np.uint8).reshape(height, width, 4)
                rows = []
                for y0 in range(0, height, size):
                    for x0 in range(0, width, size):
                        w, h = min(size, width - x0), min(size, height - y0)
                        out = np.zeros((h + 2, w + 2, CHANNELS), np.uint8)
                        top, left, bottom, right = max(0, y0 - 1), max(0, x0 - 1), min(height, y0 + h + 1), min(width, x0 + w + 1)
                        part = out[top - y0 + 1 : bottom - y0 + 1, left - x0 + 1 : right - x0 + 1]
                        part[:, :, :4], part[:, :, 4] = image[top:bottom, left:right], 1
                        rows.append((page.as_py(), width, height, x0, y0, w, h, 1, out.tobytes()))
                        if len(rows) == BATCH:
                            yield _batch(rows, kind, schema.names)
                            rows = []
                if rows:
                    yield _batch(rows, kind, schema.names)

    return rasters.select("page_id", "width", "height", "rgba").mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, *[pa.int32()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def to_pixels(tiles: DataFrame) -> DataFrame:
    """The pixel table of tiles: page_id, px, py, r, g, b, a."""
    schema = T.StructType([tiles.schema["page_id"], *(T.StructField(c, T.IntegerType()) for c in ("px", "py", "r", "g", "b", "a"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            kind = b.schema.field("page_id").type
            for f in b.to_pylist():
                p = _inner(_array(f, f["data"]), f)
                y, x = np.nonzero(p[:, :, 4])
                columns = [pa.array([f["page_id"]] * len(x), kind), pa.array((x + f["x0"]).astype(np.int32)), pa.array((y + f["y0"]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(p[y, x, i].astype(np.int32)) for i in range(4))], schema.names)

    return tiles.mapInArrow(run, schema)


def _repaint(pixels: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[:, :, :3] = np.where(pixels[:, :, 4:] > 0, values[:, :, None], 0)
    return out


def _luminance(p: np.ndarray) -> np.ndarray:
    return np.floor(0.299 * p[:, :, 0] + 0.587 * p[:, :, 1] + 0.114 * p[:, :, 2] + 0.5).astype(np.uint8)


def gray(tiles: DataFrame) -> DataFrame:
    return _each(tiles, lambda p, f: (_repaint(p, _luminance(p)), f))


def blur(tiles: DataFrame) -> DataFrame:
    """1-2-1 blur both ways of gray tiles; what has not all eight neighbours stays. The border is used up."""

    def work(p: np.ndarray, f: Frame) -> tuple[np.ndarray, Frame]:
        if not f["halo"]:
            raise ValueError("these tiles have no border left")
        v, there = p[:, :, 0].astype(np.int32), p[:, :, 4].astype(np.int32)
        sides = lambda a: a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
        total, whole = (sides(a)[:-2] + 2 * sides(a)[1:-1] + sides(a)[2:] for a in (v, there))
        inner = _inner(p, f)
        return _repaint(inner, np.where(whole == 16, (total + 8) // 16, inner[:, :, 0]).astype(np.uint8)), f | {"halo": 0}

    return _each(tiles, work)


def histogram(tiles: DataFrame) -> DataFrame:
    """(page_id, v, n) of gray tiles: 256 rows a tile at most are shuffled."""
    schema = T.StructType([tiles.schema["page_id"], T.StructField("v", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            kind = b.schema.field("page_id").type
            for f in b.to_pylist():
                p = _inner(_array(f, f["data"]), f)
                n = np.bincount(p[:, :, 0][p[:, :, 4] > 0], minlength=256)
                v = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([f["page_id"]] * len(v), kind), pa.array(v.astype(np.int32)), pa.array(n[v])], schema.names)

    return tiles.mapInArrow(run, schema).groupBy("page_id", "v").agg(F.sum("n").alias("n"))


def _with_page(tiles: DataFrame, told: DataFrame) -> DataFrame:
    """Tiles with the one row of their page; a page's tiles are dealt over SPREAD keys."""
    part = F.pmod(F.xxhash64("x0", "y0"), F.lit(SPREAD)).cast("int")
    copies = told.withColumn("_part", F.explode(F.array(*map(F.lit, range(SPREAD)))))
    return tiles.withColumn("_part", part).join(copies, ["page_id", "_part"]).drop("_part")


def binarize(tiles: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """White above the page's threshold, else black."""
    told = thresholds_of(histogram(tiles)) if thresholds is None else thresholds
    return _each(_with_page(tiles, told), lambda p, f: (_repaint(p, np.where(p[:, :, 0] > f["threshold"], 255, 0).astype(np.uint8)), f), ("threshold",))


def equalize(tiles: DataFrame, clip: float = CLIP) -> DataFrame:
    """Clipped histogram equalization of gray tiles."""
    tones = tones_of(histogram(tiles), clip).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "to"))), lambda t: t["to"]).alias("tones"))
    return _each(_with_page(tiles, tones), lambda p, f: (_repaint(p, np.array(f["tones"], np.uint8)[p[:, :, 0]]), f), ("tones",))


def enhance(tiles: DataFrame, threshold: bool = False) -> DataFrame:
    """Gray, blurred, equalized and, if wanted, binarized."""
    out = equalize(blur(gray(tiles)))
    return binarize(out) if threshold else out


def cell_stats(tiles: DataFrame, grid: int = GRID) -> DataFrame:
    """page_id, row, col, cell, textured and bimodal, as raster.cell_stats: a tile gives whole-number sums for each cell that it has a part of."""
    schema = T.StructType([tiles.schema["page_id"], *(T.StructField(c, T.LongType()) for c in ("row", "col", "cell", "n", "s", "ss", "extreme"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            kind = b.schema.field("page_id").type
            for f in b.to_pylist():
                cell = max(LEAST_CELL, max(f["page_w"], f["page_h"]) // grid)
                rows, cols = f["page_h"] // cell, f["page_w"] // cell
                p = _inner(_array(f, f["data"]), f)
                y, x = np.nonzero(p[:, :, 4])
                row, col = (y + f["y0"]) // cell, (x + f["x0"]) // cell
                keep = (row < rows) & (col < cols) & (rows >= 2) & (cols >= 2)
                v = _luminance(p)[y, x][keep].astype(np.int64)
                at, place = np.unique(row[keep] * cols + col[keep], return_inverse=True)
                sums = [np.bincount(place, x, len(at)).astype(np.int64) for x in (np.ones(len(v)), v, v * v, (v <= DARK) | (v >= LIGHT))]
                yield pa.RecordBatch.from_arrays([pa.array([f["page_id"]] * len(at), kind), *map(pa.array, (at // max(cols, 1), at % max(cols, 1), np.full(len(at), cell), *sums))], schema.names)

    found = tiles.mapInArrow(run, schema).groupBy("page_id", "row", "col").agg(F.max("cell").alias("cell"), *(F.sum(c).alias(c) for c in ("n", "s", "ss", "extreme")))
    spread = F.sqrt((F.col("n") * F.col("ss") - F.col("s") * F.col("s")).cast("double")) / F.col("n")
    return found.select("page_id", "row", "col", "cell", (spread >= TEXTURE).alias("textured"), (F.col("extreme") / F.col("n") >= EXTREME).alias("bimodal"))


def paint(tiles: DataFrame, masks: DataFrame, size: int = SIZE) -> DataFrame:
    """Black where a mask (page_id, x, y, w, h) covers a pixel, partly covered ones too. Tiles without a mask are not worked on.

    Masks meet tiles by the squares of `size` pixels that both touch; the tiles' data is joined once, with the masks of each.
    """
    squares = lambda a, b: F.sequence(F.floor(a / size), F.floor((b - 1) / size))
    edges = masks.select("page_id", F.floor("x").alias("x1"), F.floor("y").alias("y1"), F.ceil(F.col("x") + F.col("w")).alias("x2"), F.ceil(F.col("y") + F.col("h")).alias("y2"))
    edges = edges.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    on = edges.withColumn("sx", F.explode(squares(F.col("x1"), F.col("x2")))).withColumn("sy", F.explode(squares(F.col("y1"), F.col("y2"))))
    own = tiles.select(*KEY, "w", "h").withColumn("sx", F.explode(squares(F.col("x0"), F.col("x0") + F.col("w")))).withColumn("sy", F.explode(squares(F.col("y0"), F.col("y0") + F.col("h"))))
    touch = (F.col("x1") < F.col("x0") + F.col("w") + 1) & (F.col("x2") > F.col("x0") - 1) & (F.col("y1") < F.col("y0") + F.col("h") + 1) & (F.col("y2") > F.col("y0") - 1)
    met = own.join(on, ["page_id", "sx", "sy"]).where(touch).groupBy(*KEY).agg(F.collect_set(F.struct("x1", "y1", "x2", "y2")).alias("masks"))

    def work(p: np.ndarray, f: Frame) -> tuple[np.ndarray, Frame]:
        if not f["masks"]:
            return p, f
        out, dx, dy = p.copy(), f["x0"] - f["halo"], f["y0"] - f["halo"]
        for m in f["masks"]:
            part = out[max(0, m["y1"] - dy) : max(0, m["y2"] - dy), max(0, m["x1"] - dx) : max(0, m["x2"] - dx)]
            there = part[:, :, 4] > 0
            part[there] = (0, 0, 0, 255, 1)
        return out, f

    return _each(tiles.join(met, KEY, "left"), work, ("masks",))


def rotate(tiles: DataFrame, rotation: int) -> DataFrame:
    """Clockwise by 90, 180 or 270 degrees: each tile by itself, without a shuffle."""
    turns = {90: 3, 180: 2, 270: 1}[rotation]

    def work(p: np.ndarray, f: Frame) -> tuple[np.ndarray, Frame]:
        right, below = f["page_w"] - f["x0"] - f["w"], f["page_h"] - f["y0"] - f["h"]
        x0, y0 = {90: (below, f["x0"]), 180: (right, below), 270: (f["y0"], right)}[rotation]
        turned = f | {"x0": x0, "y0": y0}
        if rotation != 180:
            turned |= {"page_w": f["page_h"], "page_h": f["page_w"], "w": f["h"], "h": f["w"]}
        return np.ascontiguousarray(np.rot90(p, turns)), turned

    return _each(tiles, work)


def crop(tiles: DataFrame, y0: int, y1: int) -> DataFrame:
    """Rows y0 to y1 of each page, moved to the top. Tiles that have none of them are not read."""

    def work(p: np.ndarray, f: Frame) -> tuple[np.ndarray, Frame]:
        top, bottom = max(f["y0"], y0), min(f["y0"] + f["h"], y1)
        inner = _inner(p, f)[top - f["y0"] : bottom - f["y0"]]
        return np.ascontiguousarray(inner), f | {"page_h": min(f["page_h"], y1) - y0, "y0": top - y0, "h": bottom - top, "halo": 0}

    some: Column = (F.col("y0") < y1) & (F.col("y0") + F.col("h") > y0) & (F.col("page_h") > y0)
    return _each(tiles.where(some), work)
