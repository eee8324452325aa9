"""Reading order and aspect-ratio batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boxes whose tops are less apart than this stand in one line.
LINE_STEP = 10
#: Width to height ratio that a recogniser batch has at least.
LEAST_RATIO = 320 / 48


def reading_order(df: DataFrame, image: str = "image_id", x: str = "x0", y: str = "y0", ties: Sequence[str] = ("box_idx",), step: float = LINE_STEP) -> DataFrame:
    """Adds line_id and reading_rank (both from 0): lines from top to bottom, boxes in them from left to right.

    A line begins where the top is ``step`` or more below the box before it in order of tops. One shuffle on the image.
    """
    down = Window.partitionBy(image).orderBy(y, *ties)
    df = df.withColumn("_new", F.coalesce((F.col(y) - F.lag(y).over(down) >= step).cast("int"), F.lit(0)))
    df = df.withColumn("line_id", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    across = Window.partitionBy(image).orderBy("line_id", x, y, *ties)
    return df.withColumn("reading_rank", (F.row_number().over(across) - 1).cast("int")).drop("_new")


def aspect_batches(df: DataFrame, ratio: Column | str, image: str = "image_id", ties: Sequence[str] = ("box_idx",), size: int = 6, least: float = LEAST_RATIO) -> DataFrame:
    """Adds batch (from 0) and max_ratio: crops of an image by width to height ratio, ``size`` to a batch.

    The batch is a function of the image and the rank, never of how rows reach a task, because the padded width of a crop depends on its batch.
    """
    df = df.withColumn("_ratio", F.col(ratio) if isinstance(ratio, str) else ratio)
    rank = F.row_number().over(Window.partitionBy(image).orderBy("_ratio", *ties))
    df = df.withColumn("batch", F.floor((rank - 1) / F.lit(size)).cast("int"))
    return df.withColumn("max_ratio", F.greatest(F.lit(least), F.max("_ratio").over(Window.partitionBy(image, "batch")))).drop("_ratio")
