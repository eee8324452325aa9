"""Table functions for SQL: rows of one page in, words or regions of that page out.

Used with ``TABLE(...) PARTITION BY`` the page, which Spark brings together in one task; a page's rows are bounded by the
page itself. Without PARTITION BY the whole table would be one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators.detection import borders, boxes_of_map


WORD_NAMES = ["image_id", "box_idx", "word_idx", "txt", "conf", "box"]
WORD_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))]


class ExplodeWords:
    """Rows image_id, box_idx, words (in the order of the lines) -> every word with a text and a box, numbered over the whole page."""

    def __init__(self):
        self.n = 0

    def eval(self, page: pa.RecordBatch) -> Iterator[pa.Table]:
        """All lines of a page, or of a part of one, at once."""
        lines = page.column("words")
        words, line = lines.flatten(), pc.list_parent_indices(lines)
        txt, conf, box = (pc.struct_field(words, [c]) for c in ("txt", "conf", "box"))
        some = pc.and_(pc.is_valid(txt), pc.fill_null(pc.greater(pc.list_value_length(box), 0), False))
        line, number = line.filter(some), pa.array(np.arange(len(some)), pa.int32())
        number = pc.add(number.slice(0, len(line)), pa.scalar(self.n, pa.int32()))
        self.n += len(line)
        yield pa.table([x.cast(t) for x, t in zip((page.column("image_id").take(line), page.column("box_idx").take(line), number, *(x.filter(some) for x in (txt, conf, box))), WORD_TYPES)], WORD_NAMES)


class _Map:
    """Collects rows key, y, values of one map."""

    def __init__(self):
        self.key, self.lines, self.settings = None, {}, ()

    def eval(self, row: Row, *settings) -> None:
        self.key, self.lines[row["y"]], self.settings = row["image_id"], row["probs"], settings

    def map(self) -> np.ndarray:
        """The rows that are there; what is missing of a map is 0."""
        out = np.zeros((max(self.lines) + 1, max(len(v) for v in self.lines.values())))
        for y, values in self.lines.items():
            out[y, : len(values)] = [0.0 if v is None else v for v in values]
        return out


class BoxesOfMap(_Map):
    """Rows image_id, y, probs of a probability map, and the page's height and width -> text boxes with scores."""

    def terminate(self) -> Iterator[tuple]:
        if self.lines:
            for i, (box, score) in enumerate(boxes_of_map(self.map(), *map(int, self.settings))):
                yield self.key, i, [(float(x), float(y)) for x, y in box], score


class RegionsOfMap(_Map):
    """Rows image_id, y, probs of a map, a threshold and a limit -> bounds of the borders of regions and holes, the lowest first, as the detector examines them."""

    def terminate(self) -> Iterator[tuple]:
        if self.lines:
            thresh, limit = self.settings
            for i, (cells, hole) in enumerate(borders(self.map() > float(thresh))[: int(limit)]):
                yield self.key, i, hole, len(cells), *cells.min(0).tolist(), *cells.max(0).tolist()


TABLES = {
    "explode_words": (ExplodeWords, "image_id string, box_idx int, word_idx int, txt string, conf double, box array<struct<x:double,y:double>>"),
    "boxes_of_map": (BoxesOfMap, "image_id string, box_idx int, box array<struct<x:double,y:double>>, det_score double"),
    "regions_of_map": (RegionsOfMap, "image_id string, region int, hole boolean, cells long, x0 long, y0 long, x1 long, y1 long"),
}


def register_tables(spark: SparkSession) -> None:
    """explode_words(TABLE lines), boxes_of_map(TABLE rows, height, width) and regions_of_map(TABLE rows, threshold, limit)."""
    for name, (kind, schema) in TABLES.items():
        spark.udtf.register(name, (arrow_udtf if kind is ExplodeWords else udtf)(kind, returnType=schema))
