"""Filters on recognised lines, kinds of result, overlay instructions, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_height, box_width
from ..functions.text import index_label, is_blank


def drop_blank(df: DataFrame, txt: str = "txt") -> DataFrame:
    """Lines with something other than white space."""
    return df.where(~is_blank(txt))


def drop_low_scores(df: DataFrame, score: str = "rec_score", least: float = 0.5) -> DataFrame:
    return df.where(F.col(score) >= least)


def drop_empty_words(df: DataFrame, words: str = "words") -> DataFrame:
    """Words without a box go, then lines without a word."""
    return df.withColumn(words, F.filter(words, lambda w: w["box"].isNotNull())).where(F.size(words) > 0)


def flat_words(df: DataFrame, words: str = "words", image: str = "image_id") -> DataFrame:
    """One row per word that has a text, a confidence and a box."""
    out = df.select(image, "box_idx", F.posexplode(words).alias("word_idx", "w")).select(image, "box_idx", "word_idx", "w.*")
    return out.where("txt is not null and conf is not null and box is not null")


def should_turn(label: Column | str, score: Column | str, least: float = 0.9) -> Column:
    """Whether a crop stands on its head."""
    label, score = (F.col(x) if isinstance(x, str) else x for x in (label, score))
    return label.contains("180") & (score > least)


def result_kind(box: Column, txt: Column, cls: Column) -> Column:
    """What a result is, by the stages that gave one."""
    return F.when(box.isNotNull() & txt.isNotNull(), "ocr").when(box.isNotNull(), "det").when(txt.isNotNull(), "rec").when(cls.isNotNull(), "cls").otherwise("empty")


def colour(index: Column) -> Column:
    """struct(red, green, blue) of a box: looks random, but is the same in every run."""
    return F.struct(*(((index * a + b) % 256).alias(c) for c, a, b in (("red", 67, 29), ("green", 131, 71), ("blue", 197, 113))))


def can_be_shown(box: Column, txt: Column, score: Column) -> Column:
    return box.isNotNull() & txt.isNotNull() & score.isNotNull()


def overlay(df: DataFrame, box: str = "box", index: str = "box_idx", score: str = "score", least: float = 0.5) -> DataFrame:
    """Adds what a drawer needs: label, anchor, visible, vertical, font_size."""
    w, h = box_width(box), box_height(box)
    tall = h > w * 2
    size = F.greatest(F.when(tall, (w * 0.9).cast("int")).otherwise((h * 0.8).cast("int")), F.lit(10))
    first = F.get(F.col(box), 0)
    return df.withColumns({"label": index_label(F.col(index), F.col(score)), "anchor_x": F.rint(first["x"]).cast("int"), "anchor_y": F.rint(first["y"]).cast("int"), "visible": F.col(score) >= least, "vertical": tall, "font_size": size.cast("int")})


def stacked_offsets(df: DataFrame, image: str, order: list[str], height: str = "height", width: str = "width") -> DataFrame:
    """Adds offset (sum of the heights before) and canvas_width for images stacked from top to bottom."""
    w = Window.partitionBy(image).orderBy(*order)
    return df.withColumns({"offset": F.coalesce(F.sum(height).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "canvas_width": F.max(width).over(Window.partitionBy(image))})


def page_elapse(lines: DataFrame, image: str = "image_id") -> DataFrame:
    """Seconds of each stage and of all stages of an image, from the pipeline's lines; stages that did not run are null and count as nothing."""
    stages = ["det_elapse", "cls_elapse", "rec_elapse"]
    pages = lines.groupBy(image).agg(*(F.max(c).alias(c) for c in stages))
    return pages.withColumn("total_elapse", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in stages), F.lit(0.0)))


def total_elapse(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Sum of the stages' times; stages that did not run are null and count as nothing."""
    return df.groupBy(*by).agg(F.sum(seconds).alias("elapse"), F.count(seconds).alias("stages"))
