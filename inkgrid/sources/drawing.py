"""Pictures of results: boxes on the page with their numbers and scores, the page beside what was read, crops beside their texts.

Fonts are the user's: a function from a character and a size to a mask is all that texts need (``glyph_drawer``). Numbers
and scores are drawn with small digits that are kept here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.detection import inside_polygon
from ..schemas import IMAGES
from . import pixels
from .images import array_of, image_row, in_parts

#: Draws a text into a box (four points) of an array; fonts are the user's.
TextDrawer = Callable[[np.ndarray, np.ndarray, str], None]


#: The shape of a character at a size: a mask of that height, true where there is ink.
Glyph = Callable[[str, int], np.ndarray]

# Digits, colon and point, three dots wide and five high, a row of dots to each part.
DOTS = {
    "0": "111 101 101 101 111", "1": "010 110 010 010 111", "2": "111 001 111 100 111", "3": "111 001 111 001 111", "4": "101 101 111 001 001",
    "5": "111 100 111 001 111", "6": "111 100 111 101 111", "7": "111 001 010 010 010", "8": "111 101 111 101 111", "9": "111 101 111 001 111",
    ":": "000 010 000 010 000", ".": "000 000 000 000 010",
}


def small_glyph(char: str, size: int) -> np.ndarray:
    """A digit, colon or point at (about) this height; other characters are a frame."""
    rows = DOTS.get(char, "111 101 101 101 111").split()
    dots = np.array([[c == "1" for c in r] for r in rows])
    return np.kron(dots, np.ones((max(1, size // 5),) * 2, bool))


def put_glyph(a: np.ndarray, mask: np.ndarray, x: int, y: int, colour: tuple[int, int, int]) -> None:
    """Ink a mask into ``a`` with its upper left corner at (x, y); what is outside is left out."""
    x0, y0 = max(0, -x), max(0, -y)
    part = mask[y0 : max(0, a.shape[0] - y), x0 : max(0, a.shape[1] - x)]
    if part.size:
        a[y + y0 : y + y0 + part.shape[0], x + x0 : x + x0 + part.shape[1]][part] = colour


def glyph_drawer(glyph: Glyph, colour: tuple[int, int, int] = (0, 0, 0)) -> TextDrawer:
    """Draws texts from a box's first corner on: along it at 0.8 of its height, or down a box over twice as high as wide at 0.9 of its width, at least 10."""

    def draw(a: np.ndarray, box: np.ndarray, text: str) -> None:
        w, h = float(np.linalg.norm(box[0] - box[1])), float(np.linalg.norm(box[0] - box[3]))
        down = h > 2 * w
        size = max(int(w * 0.9) if down else int(h * 0.8), 10)
        x, y = (int(v) for v in np.rint(box[0]))
        for c in text:
            mask = glyph(c, size)
            put_glyph(a, mask, x, y, colour)
            x, y = (x, y + mask.shape[0] + 1) if down else (x + mask.shape[1] + 1, y)

    return draw


def colour_of(index: int) -> tuple[int, int, int]:
    """Blue, green, red of a box; the same numbers as ``operators.results.colour``."""
    return (index * 197 + 113) % 256, (index * 131 + 71) % 256, (index * 67 + 29) % 256


def outline(a: np.ndarray, points: Sequence[Sequence[float]], colour: tuple[int, int, int], thickness: int = 1) -> None:
    """Draw a closed polygon into ``a``; what is outside of it is left out."""
    p = np.asarray(points, float)
    reach = np.arange(thickness) - (thickness - 1) // 2
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, 0)):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 2
        x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        for dx in reach:
            for dy in reach:
                u, v = x + dx, y + dy
                ok = (u >= 0) & (u < a.shape[1]) & (v >= 0) & (v < a.shape[0])
                a[v[ok], u[ok]] = colour


def with_boxes(a: np.ndarray, boxes: Sequence, thickness: int = 1, scores: Sequence[float | None] | None = None) -> np.ndarray:
    """The page with outlined boxes, and at each one's first corner its number and score where scores are given."""
    out = a.copy()
    for i, box in enumerate(boxes):
        outline(out, box, colour_of(i), thickness)
        if scores is not None and scores[i] is not None:
            x, y = (int(v) for v in np.rint(np.asarray(box[0], float)))
            for c in f"{i}:{scores[i]:.3f}":
                mask = small_glyph(c, 10)
                put_glyph(out, mask, x, y, colour_of(i))
                x += mask.shape[1] + 2
    return out


def blended(a: np.ndarray, boxes: Sequence) -> np.ndarray:
    """The page blended by half with its filled boxes; where boxes overlap the later one counts."""
    full = a.copy()
    for i, box in enumerate(boxes):
        p = np.asarray(box, float)
        x0, y0 = np.clip(np.floor(p.min(0)).astype(int), 0, [a.shape[1], a.shape[0]])
        x1, y1 = np.clip(np.ceil(p.max(0)).astype(int) + 1, 0, [a.shape[1], a.shape[0]])
        if x0 < x1 and y0 < y1:
            full[y0:y1, x0:x1][inside_polygon(p - [x0, y0], y1 - y0, x1 - x0)] = colour_of(i)
    return ((a.astype(np.uint16) + full) >> 1).astype(np.uint8)


def beside(a: np.ndarray, boxes: Sequence, texts: Sequence[str | None], draw_text: TextDrawer | None = None, thickness: int = 1) -> np.ndarray:
    """The page blended with its boxes, and beside it a white page with their outlines and texts."""
    panel = np.full_like(a, 255)
    for i, (box, text) in enumerate(zip(boxes, texts)):
        outline(panel, box, colour_of(i), thickness)
        if draw_text is not None and text:
            draw_text(panel, np.asarray(box, float), text)
    return np.hstack([blended(a, boxes), panel])


def captioned(crop: np.ndarray, text: str | None, draw_text: TextDrawer) -> np.ndarray:
    """A crop and, beside it, a white panel of its size with its text."""
    panel, (h, w) = np.full_like(crop, 255), crop.shape[:2]
    if text:
        draw_text(panel, np.array([(0, 0), (w, 0), (w, h), (0, h)], float), text)
    return np.hstack([crop, panel])


def stacked(crops: Sequence[np.ndarray], gap: int = 4) -> np.ndarray:
    """Crops below each other on white, from the left edge."""
    if not crops:
        return np.full((1, 1, 3), 255, np.uint8)
    out = np.full((sum(c.shape[0] + gap for c in crops) - gap, max(c.shape[1] for c in crops), 3), 255, np.uint8)
    y = 0
    for c in crops:
        out[y : y + c.shape[0], : c.shape[1]] = c
        y += c.shape[0] + gap
    return out


def line_crops(images: DataFrame, lines: DataFrame) -> DataFrame:
    """image_id, box_idx, image and error of every line with a box: its straightened crop in the page's own scale and pixels.

    ``images`` are the pages as they were decoded, so a crop has the size that the line has there, whatever size its
    page was brought to for detection. A box without area is an error row; lines whose page has no image are left out.
    """
    boxes = lines.where("box is not null").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_idx", "box"))).alias("_lines"))  # lines of one page
    pages = images.where("image is not null").join(boxes, "image_id").select("image_id", "image", "_lines")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_parts(it):
            rows = []
            for key, image, found in zip(pdf["image_id"], pdf["image"], pdf["_lines"]):
                a = array_of(image)
                for x in found:
                    try:
                        crop = pixels.straighten(a, np.array([[p["x"], p["y"]] for p in x["box"]]))
                        rows.append((key, x["box_idx"], image_row(f"{key}#{x['box_idx']}", crop), None))
                    except pixels.LoadError as e:
                        rows.append((key, x["box_idx"], None, str(e)))
            yield pd.DataFrame(rows, columns=["image_id", "box_idx", "image", "error"])

    schema = T.StructType([IMAGES["image_id"], T.StructField("box_idx", T.IntegerType()), IMAGES["image"], IMAGES["error"]])
    return pages.mapInPandas(run, schema)


KINDS = ("boxes", "beside", "words", "crops")


def overlays(images: DataFrame, lines: DataFrame, kind: str = "boxes", draw_text: TextDrawer | None = None, least: float = 0.5) -> DataFrame:
    """image_id and content (PNG) of each decoded image: ``boxes`` on the page with their numbers and scores, ``beside`` the lines' texts, the same of the ``words`` of the lines, or the ``crops`` of the lines (with ``draw_text``: beside their texts).

    Lines without a box, or with a score below ``least``, are not drawn; images without a line are drawn as they are.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    shown = lines.where(F.col("box").isNotNull() & (F.coalesce("rec_score", F.lit(1.0)) >= least))
    for c, t in (("txt", "string"), ("det_score", "double")):
        shown = shown if c in shown.columns else shown.withColumn(c, F.lit(None).cast(t))
    if kind == "words":
        word = F.posexplode("words").alias("_k", "_w")
        shown = shown.select("image_id", "box_idx", word).select("image_id", F.struct("box_idx", "_k").alias("box_idx"), F.col("_w.box").alias("box"), F.col("_w.txt").alias("txt"), F.col("_w.conf").alias("det_score")).where("box is not null")
    drawn = shown.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_idx", "box", "txt", "det_score"))).alias("_lines"))  # lines of one page
    pages = images.where("image is not null").join(drawn, "image_id", "left").select("image_id", "image", "_lines")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_parts(it):
            out = []
            for image, found in zip(pdf["image"], pdf["_lines"]):
                a = array_of(image)
                found = [] if found is None else list(found)
                boxes = [[[p["x"], p["y"]] for p in x["box"]] for x in found]
                texts = [x["txt"] for x in found]
                if kind == "boxes":
                    scores = [None if x["det_score"] is None or x["det_score"] != x["det_score"] else float(x["det_score"]) for x in found]
                    picture = with_boxes(a, boxes, scores=scores)
                elif kind == "crops":
                    crops = [pixels.straighten(a, np.array(b)) for b in boxes]
                    picture = stacked(crops if draw_text is None else [captioned(c, t, draw_text) for c, t in zip(crops, texts)])
                else:
                    picture = beside(a, boxes, texts, draw_text)
                out.append(pixels.encode_png(np.ascontiguousarray(picture[:, :, ::-1])))
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": out})

    return pages.mapInPandas(run, "image_id string, content binary")
