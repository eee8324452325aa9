"""Results as JSON rows and as Markdown that keeps the page's layout."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, gap_spaces

# Fixed value: the sentence that stands for a page without a result.
NOTHING_FOUND = "没有检测到任何文本。"


def line_props(box: Column | str) -> Column:
    """struct(top, bottom, left, right, height, width, center_y) of a box."""
    b = bounds(box)
    top, bottom, left, right = (b[k].cast("double") for k in ("top", "bottom", "left", "right"))
    return F.struct(top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right"), (bottom - top).alias("height"), (right - left).alias("width"), ((top + bottom) / 2).alias("center_y"))


def merged_props(a: Column, b: Column) -> Column:
    top, bottom, left, right = F.least(a["top"], b["top"]), F.greatest(a["bottom"], b["bottom"]), F.least(a["left"], b["left"]), F.greatest(a["right"], b["right"])
    return F.struct(top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right"), (bottom - top).alias("height"), (right - left).alias("width"), ((top + bottom) / 2).alias("center_y"))


def to_json(df: DataFrame, image: str = "image_id", index: str = "box_idx", box: str = "box", txt: str = "txt", score: str = "rec_score") -> DataFrame:
    """One row per image: json, an array of {"box", "txt", "score"} in box order, and warning.

    Where a row of the image lacks a part, there is no JSON for the image and warning says which part is missing.
    """
    row = F.struct(F.transform(F.col(box), lambda p: F.array(p["x"], p["y"])).alias("box"), F.col(txt).alias("txt"), F.col(score).alias("score"))
    lacks = [F.when(F.max(F.col(c).isNull()), F.lit(name)) for name, c in (("box", box), ("txt", txt), ("score", score))]
    missing = F.array_compact(F.array(*lacks))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), row.alias("r")))), lambda x: x["r"])
    pages = df.groupBy(image).agg(F.when(F.size(missing) == 0, F.to_json(rows)).alias("json"), missing.alias("_missing"))
    return pages.select(image, "json", F.when(F.size("_missing") > 0, F.concat(F.lit("without "), F.array_join("_missing", ", "))).alias("warning"))


def fold_lines(top: Sequence[float], bottom: Sequence[float]) -> list[int]:
    """For items from top to bottom, the number of the line that each joins: the first line that it stands in, else a new one.

    A line's extent grows with its items. Lines are found by the strips of the page that they reach into, so an item
    meets its neighbours only and a page takes time in proportion to its items.
    """
    heights = sorted(b - a for a, b in zip(top, bottom))
    strip = max(1.0, heights[len(heights) // 2]) if heights else 1.0
    lines: list[list[float]] = []
    strips: dict[int, list[int]] = {}
    out = []
    for a, b in zip(top, bottom):
        high, mid = b - a, (a + b) / 2
        reach = 0.35 * max(1.0, high)
        hit = -1
        for k in range(int((a - reach) // strip), int((b + reach) // strip) + 1):
            for n in strips.get(k, ()):
                if 0 <= hit <= n:
                    continue
                c, d, _, _ = lines[n]
                low = max(1.0, min(d - c, high))
                if max(0.0, min(d, b) - max(c, a)) / low > 0.5 or abs((c + d) / 2 - mid) < low * 0.35:
                    hit = n
        if hit < 0:
            hit = len(lines)
            lines.append([a, b, 1, 0])
        line = lines[hit]
        line[0], line[1] = min(line[0], a), max(line[1], b)
        first, last = int(line[0] // strip), int(line[1] // strip)
        for k in range(first, last + 1):
            if not line[2] <= k <= line[3]:
                strips.setdefault(k, []).append(hit)
        line[2], line[3] = (first, last) if line[2] > line[3] else (min(first, line[2]), max(last, line[3]))
        out.append(hit)
    return out


def line_numbers(top: Column, bottom: Column) -> Column:
    """``fold_lines`` of two arrays."""

    @F.pandas_udf("array<int>")
    def run(top: pd.Series, bottom: pd.Series) -> pd.Series:
        return pd.Series([fold_lines(a, b) for a, b in zip(top, bottom)])

    return run(top, bottom)


def visual_lines(df: DataFrame, image: str, index: str, box: str, txt: str) -> DataFrame:
    """One row per image and visual line: image, line (null for an image without a text), p and items (struct p, txt, k), in their order.

    The page is brought together once; lines and texts after it keep that partitioning.
    """
    known = F.col(txt).isNotNull() & F.col(box).isNotNull()
    p = line_props(box)
    item = F.struct(p["center_y"].alias("a"), p["left"].alias("b"), F.col(index).alias("c"), p.alias("p"), F.col(txt).alias("txt"))
    pages = df.groupBy(image).agg(F.array_sort(F.collect_list(F.when(known, item))).alias("_items"))
    side = lambda name: F.transform("_items", lambda x: x["p"][name])
    pages = pages.withColumn("_lines", line_numbers(side("top"), side("bottom")))
    items = pages.select(image, F.posexplode_outer(F.arrays_zip("_items", "_lines")).alias("_k", "_x"))
    items = items.select(image, "_k", F.col("_x._lines").alias("line"), F.col("_x._items.p").alias("_p"), F.col("_x._items.txt").alias("_txt"))
    least, most = (lambda c: F.min(f"_p.{c}")), (lambda c: F.max(f"_p.{c}"))
    lines = items.groupBy(image, "line").agg(
        least("top").alias("_t"), most("bottom").alias("_b"), least("left").alias("_l"), most("right").alias("_r"),
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct(F.col("_p.left").alias("a"), F.col("_k").alias("k"), F.col("_p").alias("p"), F.col("_txt").alias("txt"))))).alias("items"),
    )
    whole = F.struct(F.col("_t").alias("top"), F.col("_b").alias("bottom"), F.col("_l").alias("left"), F.col("_r").alias("right"), (F.col("_b") - F.col("_t")).alias("height"), (F.col("_r") - F.col("_l")).alias("width"), ((F.col("_t") + F.col("_b")) / 2).alias("center_y"))
    return lines.select(image, "line", whole.alias("p"), "items")


def line_text(items: Column) -> Column:
    """Text of a visual line: items from left to right, gaps as spaces."""

    def part(x: Column, k: Column) -> Column:
        before = F.get(items, k - 1)["p"]
        n = gap_spaces(x["p"]["left"] - before["right"], before["width"], x["p"]["width"])
        return F.concat(F.when(k > 0, F.repeat(F.lit(" "), n)).otherwise(""), x["txt"])

    return F.array_join(F.transform(items, part), "")


def to_markdown(df: DataFrame, image: str = "image_id", index: str = "box_idx", box: str = "box", txt: str = "txt") -> DataFrame:
    """One row per image: markdown. A gap of over 0.8 of the taller neighbour's height becomes an empty line; an image whose texts are all null has NOTHING_FOUND."""
    found = visual_lines(df, image, index, box, txt)
    line = F.struct(F.col("p.top").alias("a"), F.col("p.left").alias("b"), F.col("line").alias("c"), F.col("p"), line_text(F.col("items")).alias("txt"))
    pages = found.groupBy(image).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), line))).alias("_lines"))
    lines = F.col("_lines")

    def part(y: Column, k: Column) -> Column:
        before = F.get(lines, k - 1)["p"]
        wide = (y["p"]["top"] - before["bottom"]) > F.greatest(before["height"], y["p"]["height"]) * 0.8
        return F.concat(F.when((k > 0) & wide, "\n").otherwise(""), y["txt"])

    return pages.select(image, F.when(F.size("_lines") == 0, NOTHING_FOUND).otherwise(F.array_join(F.transform(lines, part), "\n")).alias("markdown"))


def paragraph_breaks(df: DataFrame, image: str, order: list[str], top: str = "top", bottom: str = "bottom") -> DataFrame:
    """Adds new_paragraph: the line stands over 0.8 of the taller of both heights below the one before."""
    w = Window.partitionBy(image).orderBy(*order)
    gap = F.col(top) - F.lag(bottom).over(w)
    tall = F.greatest(F.col(bottom) - F.col(top), F.lag(F.col(bottom) - F.col(top)).over(w))
    return df.withColumn("new_paragraph", F.coalesce(gap > tall * 0.8, F.lit(False)))
