"""Word and character boxes from the uniform columns of a recognised line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, trunc


def column_width(box_width: Column | str, line_txt_len: Column | str) -> Column:
    return col(box_width) / col(line_txt_len)


def char_width_of_word(cols: Column, column: Column) -> Column:
    """Mean advance of a word's characters; null for words of one character."""
    n = F.size(cols)
    return F.when(n > 1, (F.element_at(cols, -1) - F.get(cols, 0)) * column / (n - 1))


def char_width(words: Column, column: Column, box_width: Column, letters: Column) -> Column:
    """Mean over the words that have a width of their own, else the box's width by letter."""
    own = F.filter(F.transform(words, lambda w: char_width_of_word(w["cols"], column)), lambda x: x.isNotNull())
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)).otherwise(box_width / letters)


def char_cell(at: Column | str, column: Column | str, char: Column | str, left: Column | str, box_width: Column | str) -> Column:
    """struct(x0, x1) of the character in time step ``at``, inside the line's box."""
    center = (col(at) + 0.5) * col(column)
    x0 = F.greatest(trunc(center - col(char) / 2), F.lit(0)) + col(left)
    x1 = F.least(trunc(center + col(char) / 2), trunc(col(box_width))) + col(left)
    return F.struct(x0.alias("x0"), x1.alias("x1"))


def cells(cols: Column, column: Column, char: Column, left: Column, box_width: Column) -> Column:
    """Cells of several time steps, from left to right."""
    return F.array_sort(F.transform(cols, lambda c: char_cell(c, column, char, left, box_width)))


def word_cell(cells_: Column) -> Column:
    """Bounding cell of a word's characters."""
    return F.struct(F.array_min(F.transform(cells_, lambda c: c["x0"])).alias("x0"), F.array_max(F.transform(cells_, lambda c: c["x1"])).alias("x1"))


def by_words(words: Column, single_chars: bool) -> Column:
    """Whether boxes are by word: every word is of letters and digits, and characters aren't asked for."""
    return F.lit(not single_chars) & F.forall(words, lambda w: w["type"] == "en&num")


def mean_confidence(confs: Column) -> Column:
    return F.aggregate(confs, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(confs), F.lit(0))


def overlap_repair(df: DataFrame, line: list[str], order: list[str], left: str = "x0", right: str = "x1") -> DataFrame:
    """Neighbouring boxes that overlap meet in the middle. Each edge moves at most once, so all rows are independent."""
    w = Window.partitionBy(*line).orderBy(*order)
    before, after = F.lag(right).over(w), F.lead(left).over(w)
    new_left = F.when(before > F.col(left), (before + F.col(left)) / 2).otherwise(F.col(left))
    new_right = F.when(F.col(right) > after, (F.col(right) + after) / 2).otherwise(F.col(right))
    return df.withColumns({"_l": new_left, "_r": new_right}).drop(left, right).withColumnsRenamed({"_l": left, "_r": right})


def overlap_repair_array(cells_: Column) -> Column:
    """The same for an array of struct(x0, x1)."""
    def fix(c: Column, i: Column) -> Column:
        before, after = F.get(cells_, i - 1)["x1"], F.get(cells_, i + 1)["x0"]
        return F.struct(F.when((i > 0) & (before > c["x0"]), (before + c["x0"]) / 2.0).otherwise(c["x0"].cast("double")).alias("x0"), F.when(c["x1"] > after, (c["x1"] + after) / 2.0).otherwise(c["x1"].cast("double")).alias("x1"))

    return F.transform(cells_, fix)
