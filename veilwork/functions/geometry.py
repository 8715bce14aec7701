"""Box arithmetic on columns. A box is struct<x, y, w, h: double>, top-left corner and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))


def from_edges(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def box_union(a: Column, b: Column) -> Column:
    return from_edges(
        F.least(a["x"], b["x"]), F.least(a["y"], b["y"]),
        F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"]),
    )


def hull_agg(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The hull of a group's boxes."""
    return from_edges(F.min(x), F.min(y), F.max(x + w), F.max(y + h))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Touching is no overlap."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def intersection(a: Column, b: Column) -> Column:
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def overlap_fraction(a: Column, b: Column) -> Column:
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def quad_to_box(quad: Column) -> Column:
    """The box around four corners tl, tr, bl, br, each with x and y."""
    side = lambda f, c: f(*(quad[k][c] for k in ("tl", "tr", "bl", "br")))
    return from_edges(side(F.least, "x"), side(F.least, "y"), side(F.greatest, "x"), side(F.greatest, "y"))


def _grown(b: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    return from_edges(
        F.greatest(zero, b["x"] - dx), F.greatest(zero, b["y"] - dy),
        F.least(width.cast("double"), b["x"] + b["w"] + dx), F.least(height.cast("double"), b["y"] + b["h"] + dy),
    )


def pad_px(b: Column, px: float, width: Column, height: Column) -> Column:
    """Grow by px on each side, within the page."""
    return _grown(b, F.lit(float(px)), F.lit(float(px)), width, height)


def expand_frac(b: Column, share: float, width: Column, height: Column) -> Column:
    """Grow by a share of the size on each side, within the page."""
    return _grown(b, b["w"] * share, b["h"] * share, width, height)


#: Growth of code masks in pixels and of face masks in shares.
QR_PAD, FACE_SHARE = 5.0, 0.15


def mask_bounds(kind: Column, mask: Column, width: Column, height: Column) -> Column:
    """What is painted for a detection: codes and faces grow within the page, text masks stay."""
    return F.when(kind.isin("uidai_qr", "other_qr"), pad_px(mask, QR_PAD, width, height)).when(kind == "face", expand_frac(mask, FACE_SHARE, width, height)).otherwise(mask)


def normalize_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box of two corners in any order."""
    return box(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def _within(v: Column, top: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, top))


def clamp_move(b: Column, width: Column, height: Column) -> Column:
    """Keep the size, and the corner where the box is on the page."""
    return box(_within(b["x"], width - b["w"]), _within(b["y"], height - b["h"]), b["w"], b["h"])


def clamp_resize(b: Column, width: Column, height: Column) -> Column:
    """The corner onto the page, then the size to what is left."""
    x, y = _within(b["x"], width), _within(b["y"], height)
    return box(x, y, F.least(b["w"], width - x), F.least(b["h"], height - y))


def clamp_draw(b: Column, width: Column, height: Column) -> Column:
    """Each number on its own."""
    return box(_within(b["x"], width), _within(b["y"], height), _within(b["w"], width), _within(b["h"], height))


def resize_by_handle(b: Column, handle: Column, x: Column, y: Column) -> Column:
    """Move the edges that the handle names (n, s, e, w) to a point."""
    left = F.when(handle.contains("w"), x).otherwise(b["x"])
    right = F.when(handle.contains("e"), x).otherwise(b["x"] + b["w"])
    top = F.when(handle.contains("n"), y).otherwise(b["y"])
    bottom = F.when(handle.contains("s"), y).otherwise(b["y"] + b["h"])
    return normalize_box(left, top, right, bottom)


def point_in_box(x: Column, y: Column, b: Column) -> Column:
    """Edges count as inside."""
    return x.between(b["x"], b["x"] + b["w"]) & y.between(b["y"], b["y"] + b["h"])


#: Fixed value: the longest edge of a working raster.
LONG_EDGE = 2400


def fit_within(width: Column, height: Column, edge: int = LONG_EDGE) -> Column:
    """Size and scale of a raster whose long edge is `edge` at most."""
    long = F.greatest(width, height)
    scale = F.when(long <= edge, F.lit(1.0)).otherwise(edge / long)
    return F.struct(round_half_up(width * scale).alias("width"), round_half_up(height * scale).alias("height"), scale.alias("scale"))


def rotated_dims(width: Column, height: Column, rotation: Column) -> Column:
    turned = rotation.isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))
