"""Box and page geometry as column expressions. A point is struct<x,y>, a box an array of four points from the top left clockwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col, half_even, to_multiple, trunc


def point(x, y) -> Column:
    return F.struct(col(x).alias("x"), col(y).alias("y"))


def rectangle(x, y, w, h) -> Column:
    x, y, w, h = col(x), col(y), col(w), col(h)
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"].cast("double") - q["x"], p["y"].cast("double") - q["y"]
    return F.sqrt(dx * dx + dy * dy)


# -- page sizes ----------------------------------------------------------------------------------


def _scaled(h: Column, w: Column, ratio: Column) -> tuple[Column, Column]:
    return to_multiple(trunc(h * ratio)), to_multiple(trunc(w * ratio))


def _size(h: Column, w: Column, ratio: Column, needed: Column) -> Column:
    rh, rw = _scaled(h, w, ratio)
    rh, rw = F.when(needed, rh).otherwise(h.cast("int")), F.when(needed, rw).otherwise(w.cast("int"))
    bad = (rh <= 0) | (rw <= 0)
    one = F.lit(1.0)
    return F.struct(
        F.when(~bad, rh).alias("h"), F.when(~bad, rw).alias("w"),
        F.when(~bad, F.when(needed, h / rh.cast("double")).otherwise(one)).alias("ratio_h"), F.when(~bad, F.when(needed, w / rw.cast("double")).otherwise(one)).alias("ratio_w"),
        bad.alias("failed"),
    )


def bound_longest(h, w, limit: int = 2000) -> Column:
    """struct(h, w, ratio_h, ratio_w, failed): the longer side brought down to ``limit``, sides to multiples of 32. A side of 0 fails."""
    h, w = col(h).cast("double"), col(w).cast("double")
    return _size(h, w, F.lit(float(limit)) / F.when(h > w, h).otherwise(w), F.greatest(h, w) > limit)


def raise_shortest(h, w, limit: int = 30) -> Column:
    """The same for the shorter side, brought up to ``limit``."""
    h, w = col(h).cast("double"), col(w).cast("double")
    return _size(h, w, F.lit(float(limit)) / F.when(h < w, h).otherwise(w), F.least(h, w) < limit)


def bound_sides(h, w, low: int = 30, high: int = 2000, enabled: bool = True) -> Column:
    """Both bounds after each other; ratios are of the first size to the last."""
    h, w = col(h), col(w)
    if not enabled:
        return F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), F.lit(1.0).alias("ratio_h"), F.lit(1.0).alias("ratio_w"), F.lit(False).alias("failed"))
    one = bound_longest(h, w, high)
    two = raise_shortest(one["h"], one["w"], low)
    return F.struct(two["h"].alias("h"), two["w"].alias("w"), (one["ratio_h"] * two["ratio_h"]).alias("ratio_h"), (one["ratio_w"] * two["ratio_w"]).alias("ratio_w"), (one["failed"] | F.coalesce(two["failed"], F.lit(True))).alias("failed"))


def padding(h, w, ratio: float = 8, min_height: int = 30) -> Column:
    """Rows of black above and below that a flat or low page needs; 0 if none."""
    h, w = col(h), col(w)
    flat = (w / h.cast("double") > ratio) if ratio != -1 else F.lit(False)
    target = F.greatest(trunc(w / F.lit(float(ratio))), F.lit(min_height)) * 2
    return F.when((h <= min_height) | flat, trunc(F.abs(target - h) / F.lit(2.0))).otherwise(0).cast("int")


def detector_limit(longest, kind: str = "min", configured: int = 736) -> Column:
    """Side limit of the detector for a page whose longer side is ``longest``."""
    if kind == "min":
        return F.lit(configured)
    x = col(longest)
    return F.when(x < 960, 960).when(x < 1500, 1500).otherwise(2000)


def detector_size(h, w, limit, kind: str = "min") -> Column:
    """struct(h, w): kind max only shrinks, any other only grows; both sides are multiples of 32; null if a side would be 0."""
    h, w, limit = col(h).cast("double"), col(w).cast("double"), col(limit).cast("double")
    side = F.greatest(h, w) if kind == "max" else F.least(h, w)
    ratio = F.when(side > limit if kind == "max" else side < limit, limit / side).otherwise(1.0)
    rh, rw = _scaled(h, w, ratio)
    return F.when((rh > 0) & (rw > 0), F.struct(rh.alias("h"), rw.alias("w")))


def padded_width(h, w, height: int, width: int) -> Column:
    """Width to which a crop is scaled at ``height``, at most ``width``."""
    return F.least(F.ceil(F.lit(float(height)) * col(w) / col(h)), F.lit(width)).cast("int")


def batch_width(ratio, height: int = 48) -> Column:
    """Input width of a recogniser batch with this largest width to height ratio."""
    return trunc(F.lit(float(height)) * col(ratio))


def crop_on_page(h, w, ratio_h, ratio_w) -> Column:
    """Size of a crop in the page's own scale."""
    return F.struct(half_even(col(h) * col(ratio_h)).cast("int").alias("h"), half_even(col(w) * col(ratio_w)).cast("int").alias("w"))


# -- boxes ---------------------------------------------------------------------------------------


def map_back(box, pad_top, pad_left, ratio_h, ratio_w, page_h, page_w) -> Column:
    """A box in the page's own coordinates: padding off, ratios on, inside the page (its far edges included)."""
    return F.transform(col(box), lambda p: point(clamp((p["x"] - col(pad_left)) * col(ratio_w), F.lit(0.0), col(page_w).cast("double")), clamp((p["y"] - col(pad_top)) * col(ratio_h), F.lit(0.0), col(page_h).cast("double"))))


def clip_box(box, h, w) -> Column:
    """Whole pixels inside 0..w-1 and 0..h-1."""
    return F.transform(col(box), lambda p: point(trunc(clamp(p["x"], 0, col(w) - 1)), trunc(clamp(p["y"], 0, col(h) - 1))))


def crop_size(box) -> Column:
    """struct(w, h, turned): sides of the straightened crop; crops at least half as high again as wide are turned."""
    p = [F.get(col(box), i) for i in range(4)]
    w = trunc(F.greatest(distance(p[0], p[1]), distance(p[2], p[3])))
    h = trunc(F.greatest(distance(p[0], p[3]), distance(p[1], p[2])))
    return F.struct(w.alias("w"), h.alias("h"), (h.cast("double") / F.nullif(w, F.lit(0)) >= 1.5).alias("turned"))


def clockwise(points) -> Column:
    """Top left, top right, bottom right, bottom left: by x in halves, each half by y. Null unless there are four points."""
    named = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731 - what is used several times is made once
    turned = lambda half: F.sort_array(F.transform(half, lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x"))))
    halves = lambda p: F.array(turned(F.slice(p, 1, 2)), turned(F.slice(p, 3, 2)))
    at = lambda h, side, end: F.get(F.get(h, side), end)
    ring = lambda h: F.transform(F.array(at(h, 0, 0), at(h, 1, 0), at(h, 1, 1), at(h, 0, 1)), lambda q: point(q["x"], q["y"]))
    by_x = F.sort_array(F.transform(col(points), lambda q: point(q["x"], q["y"])))
    return F.when(F.size(col(points)) == 4, named(by_x, lambda p: named(halves(p), ring)))


def bounds(points) -> Column:
    """struct(left, top, right, bottom) of a list of points."""
    xs, ys = F.transform(col(points), lambda p: p["x"]), F.transform(col(points), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def box_width(box) -> Column:
    return distance(F.get(col(box), 0), F.get(col(box), 1))


def box_height(box) -> Column:
    return distance(F.get(col(box), 0), F.get(col(box), 3))


def direction(box) -> Column:
    """vertical if the box is without width or at least half as high again as wide, else horizontal; of two opposite edges the longer one counts."""
    p = [F.get(col(box), i) for i in range(4)]
    w, h = F.greatest(distance(p[0], p[1]), distance(p[2], p[3])), F.greatest(distance(p[1], p[2]), distance(p[3], p[0]))
    return F.when(w < 1e-6, "vertical").when(half_even(h / w, 2) >= 1.5, "vertical").otherwise("horizontal")


def rotate_point(x, y, about_x, about_y, degrees: float) -> Column:
    """A point turned about another one."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = col(x) - col(about_x), col(y) - col(about_y)
    return point(dx * c + dy * s + col(about_x), dy * c - dx * s + col(about_y))


def area(points) -> Column:
    """Of a polygon, by the shoelace formula."""
    p = col(points)
    n = F.size(p)
    terms = F.transform(p, lambda a, i: a["x"].cast("double") * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"].cast("double") * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


def perimeter(points) -> Column:
    p = col(points)
    n = F.size(p)
    return F.aggregate(F.transform(p, lambda a, i: distance(a, F.get(p, (i + 1) % n))), F.lit(0.0), lambda s, x: s + x)


def unclip_distance(points, ratio: float = 1.6) -> Column:
    """How far a shrunk text region grows again."""
    return area(points) * ratio / perimeter(points)


def unclip_rectangle(w, h, ratio: float = 1.6) -> Column:
    """struct(d, w, h): a rectangle after growing by its own distance on every side."""
    w, h = col(w).cast("double"), col(h).cast("double")
    d = w * h * ratio / (F.lit(2.0) * (w + h))
    return F.struct(d.alias("d"), (w + d * 2).alias("w"), (h + d * 2).alias("h"))


def same_line(a: Column, b: Column) -> Column:
    """Whether two structs with top, bottom, height and center_y stand in one visual line."""
    low = F.greatest(F.lit(1.0), F.least(a["height"], b["height"]))
    overlap = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    return (overlap / low > 0.5) | (F.abs(a["center_y"] - b["center_y"]) < low * 0.35)


def gap_spaces(gap, width_before, width) -> Column:
    """Spaces between neighbours in a line: none up to a gap of 1, then one for each half of the narrower width, 1 to 12."""
    unit = F.greatest(F.lit(1.0), F.least(col(width_before), col(width)) * 0.5)
    n = half_even(col(gap) / unit).cast("int")
    return F.when(col(gap) <= 1, 0).otherwise(F.least(F.lit(12), F.greatest(F.lit(1), n))).cast("int")
