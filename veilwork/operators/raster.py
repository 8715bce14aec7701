"""Rasters as pixel tables: page_id, px, py, r, g, b, a."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwork.functions.geometry import round_half_up

#: A solid page's threshold, share of pixels at which a histogram bin is clipped, cells along the
#: long edge, least cell, texture and bimodality of a cell.
SOLID, CLIP, GRID, LEAST_CELL, TEXTURE, DARK, LIGHT, BIMODAL = 127, 0.01, 24, 8, 40.0, 32, 223, 0.55


def luminance() -> Column:
    return round_half_up(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int")


def _painted(pixels: DataFrame, value: Column) -> DataFrame:
    return pixels.withColumn("_v", value.cast("int")).withColumns({c: F.col("_v") for c in "rgb"}).drop("_v")


def to_gray(pixels: DataFrame) -> DataFrame:
    return _painted(pixels, luminance())


def _histogram(gray: DataFrame) -> DataFrame:
    return gray.groupBy("page_id", F.col("r").alias("v")).agg(F.count("*").alias("n"))


def otsu_threshold(gray: DataFrame) -> DataFrame:
    """The threshold of each gray page with the largest variance between classes, the first of equals; 127 if solid.

    Pixels become at most 256 rows a page before anything is ordered.
    """
    return thresholds_of(_histogram(gray))


def thresholds_of(histogram: DataFrame) -> DataFrame:
    """(page_id, threshold) of histograms (page_id, v, n)."""
    bins = Window.partitionBy("page_id").orderBy("v")
    page = Window.partitionBy("page_id")
    rows = histogram.withColumns({"n0": F.sum("n").over(bins), "s0": F.sum(F.col("n") * F.col("v")).over(bins), "total": F.sum("n").over(page), "sum": F.sum(F.col("n") * F.col("v")).over(page)})
    n1 = F.col("total") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("sum") - F.col("s0")) / n1
    between = F.when(n1 > 0, F.col("n0").cast("double") * n1 * gap * gap).otherwise(F.lit(0.0))
    best = rows.groupBy("page_id").agg(F.max(F.struct(between.alias("between"), -F.col("v"))).alias("best"))
    return best.select("page_id", F.when(F.col("best.between") > 0, -F.col("best.col2")).otherwise(F.lit(SOLID)).cast("int").alias("threshold"))


def binarize(gray: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    rows = gray.join(otsu_threshold(gray) if thresholds is None else thresholds, "page_id")
    return _painted(rows, F.when(F.col("r") > F.col("threshold"), 255).otherwise(0)).drop("threshold")


def equalize_clipped(gray: DataFrame, clip: float = CLIP) -> DataFrame:
    """Histogram equalization with bins clipped to a share of the pixels, what is cut off spread evenly."""
    lut = tones_of(_histogram(gray), clip).withColumnRenamed("v", "r")
    return _painted(gray.join(lut, ["page_id", "r"]), F.col("to")).drop("to").select(*gray.columns)


def tones_of(hist: DataFrame, clip: float = CLIP) -> DataFrame:
    """(page_id, v, to): the 256 tones that equalization leads those of histograms (page_id, v, n) to."""
    pages = hist.groupBy("page_id").agg(F.sum("n").alias("total"))
    pages = pages.withColumn("limit", F.greatest(F.lit(1), F.floor(F.col("total") * clip)))
    spine = pages.select("page_id", "total", "limit", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    bins = spine.join(hist, ["page_id", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    page = Window.partitionBy("page_id")
    bins = bins.withColumn("share", F.floor(F.sum(F.greatest(F.lit(0), F.col("n") - F.col("limit"))).over(page) / 256))
    bins = bins.withColumn("cdf", F.sum(F.least("n", "limit") + F.col("share")).over(page.orderBy("v")))
    bins = bins.withColumn("low", F.min(F.when(F.col("cdf") > 0, F.col("cdf"))).over(page))
    span = F.col("total") - F.col("low")
    scaled = round_half_up((F.col("cdf") - F.col("low")) / F.when(span == 0, 1).otherwise(span) * 255)
    return bins.select("page_id", "v", F.greatest(F.lit(0), F.least(F.lit(255), scaled)).cast("int").alias("to"))


def blur3x3(gray: DataFrame) -> DataFrame:
    """1-2-1 blur both ways; border pixels stay, as does what has not all eight neighbours.

    Each pixel moves twice, once with its row and once with its column, which a page's admitted size bounds.
    """

    def blurred(value: str, along: str, across: str) -> Column:
        line = Window.partitionBy("page_id", across).orderBy(along)
        near = [(F.lag(value).over(line), F.lag(along).over(line), -1), (F.lead(value).over(line), F.lead(along).over(line), 1)]
        there = [at == F.col(along) + d for _, at, d in near]
        return F.when(there[0] & there[1], near[0][0] + 2 * F.col(value) + near[1][0])

    rows = gray.withColumn("_row", blurred("r", "px", "py")).withColumn("_sum", blurred("_row", "py", "px"))
    return _painted(rows, F.when(F.col("_sum").isNotNull(), round_half_up(F.col("_sum") / 16)).otherwise(F.col("r"))).select(*gray.columns)


def enhance(pixels: DataFrame, threshold: bool = False) -> DataFrame:
    """Gray, blurred, equalized and, if wanted, binarized."""
    out = equalize_clipped(blur3x3(to_gray(pixels)))
    return binarize(out) if threshold else out


def cell_stats(pixels: DataFrame, boxes: DataFrame | None = None, grid: int = GRID) -> DataFrame:
    """Per cell of each page's grid: spread and share of extreme pixels, and whether a box (page_id, x, y, w, h)
    touches it; a box that ends on a cell's first edge does."""
    size = pixels.groupBy("page_id").agg((F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height"))
    cell = F.greatest(F.lit(LEAST_CELL), F.floor(F.greatest("width", "height") / grid)).cast("int")
    size = size.withColumn("cell", cell).withColumns({"rows": F.floor(F.col("height") / F.col("cell")), "cols": F.floor(F.col("width") / F.col("cell"))}).where("rows >= 2 AND cols >= 2")
    at = pixels.join(size, "page_id").select("page_id", "cell", "rows", "cols", luminance().alias("v"), F.floor(F.col("py") / F.col("cell")).alias("row"), F.floor(F.col("px") / F.col("cell")).alias("col"))
    at = at.where((F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols")))
    stats = at.groupBy("page_id", "row", "col").agg(F.max("cell").alias("cell"), F.stddev_pop("v").alias("spread"), F.avg(((F.col("v") <= DARK) | (F.col("v") >= LIGHT)).cast("double")).alias("extreme"))
    stats = stats.select("page_id", "row", "col", "cell", (F.col("spread") >= TEXTURE).alias("textured"), (F.col("extreme") >= BIMODAL).alias("bimodal"))
    if boxes is None:
        return stats.withColumn("has_text", F.lit(False))
    b = boxes.select(F.col("page_id").alias("_page"), *(F.col(c).alias(f"_{c}") for c in "xywh"))
    touch = (F.col("page_id") == F.col("_page")) & (F.col("_x") < (F.col("col") + 1) * F.col("cell")) & (F.col("_x") + F.col("_w") >= F.col("col") * F.col("cell"))
    touch = touch & (F.col("_y") < (F.col("row") + 1) * F.col("cell")) & (F.col("_y") + F.col("_h") >= F.col("row") * F.col("cell"))
    touched = stats.join(b, touch, "left_semi").select("page_id", "row", "col", F.lit(True).alias("has_text"))
    return stats.join(touched, ["page_id", "row", "col"], "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def mask_rows(masks: DataFrame) -> DataFrame:
    """(page_id, py, runs): the stretches of pixels, from x1 up to x2, that masks (page_id, x, y, w, h) cover in each row of a page, partly covered pixels too."""
    m = masks.select("page_id", F.floor("x").alias("x1"), F.ceil(F.col("x") + F.col("w")).alias("x2"), F.floor("y").alias("y1"), F.ceil(F.col("y") + F.col("h")).alias("y2"))
    m = m.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    lines = m.select("page_id", "x1", "x2", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("py"))
    return lines.groupBy("page_id", "py").agg(F.collect_set(F.struct("x1", "x2")).alias("runs"))


def paint_masks(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Black where a mask (page_id, x, y, w, h) covers a pixel, partly covered ones too; the input stays as it is.

    Pixels are read once and meet the stretches of their own row: no task gets a page, and a row's stretches are as many as masks lie across it.
    """
    rows = pixels.join(mask_rows(masks).withColumn("py", F.col("py").cast(pixels.schema["py"].dataType)), ["page_id", "py"], "left")
    hit = F.coalesce(F.exists("runs", lambda r: (F.col("px") >= r["x1"]) & (F.col("px") < r["x2"])), F.lit(False))
    black = {c: F.when(hit, F.lit(0 if c != "a" else 255)).otherwise(F.col(c)).cast(pixels.schema[c].dataType) for c in "rgba"}
    return rows.withColumns(black).select(*pixels.columns)


def rotate_pixels(pixels: DataFrame, rotation: int) -> DataFrame:
    """Clockwise by 90, 180 or 270 degrees."""
    size = pixels.groupBy("page_id").agg(F.max("px").alias("mx"), F.max("py").alias("my"))
    x, y, mx, my = (F.col(c) for c in ("px", "py", "mx", "my"))
    to = {90: (my - y, x), 180: (mx - x, my - y), 270: (y, mx - x)}[rotation]
    return pixels.join(size, "page_id").withColumns({"px": to[0], "py": to[1]}).drop("mx", "my")


def crop_band(pixels: DataFrame, y0: int, y1: int) -> DataFrame:
    """Rows y0 to y1, moved to the top."""
    return pixels.where((F.col("py") >= y0) & (F.col("py") < y1)).withColumn("py", F.col("py") - y0)
