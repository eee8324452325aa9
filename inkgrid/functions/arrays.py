"""Array expressions: first maximum, gathers, masks and row views of flat matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def argmax(a) -> Column:
    """Position from 0 of the first maximum; null for a null or empty array."""
    a = col(a)
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).cast("int")


def matrix_rows(a, width: int) -> Column:
    """A flat array as rows of ``width`` values."""
    a = col(a)
    n = F.floor(F.size(a) / F.lit(width)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(a, t * width + 1, width))).otherwise(F.array().cast("array<array<float>>"))


def gather(a, positions) -> Column:
    """Elements at positions from 0; null where there is none."""
    a = col(a)
    return F.transform(col(positions), lambda i: F.get(a, i))


def select_mask(a, mask) -> Column:
    """Elements whose mask is true."""
    return F.transform(F.filter(F.arrays_zip(col(a).alias("v"), col(mask).alias("m")), lambda x: x["m"]), lambda x: x["v"])


def class_index(vocab) -> Column:
    """Map from token to class; of a token that occurs again, the first class."""
    v = col(vocab)
    return F.map_from_entries(F.transform(F.array_distinct(v), lambda t: F.struct(t, (F.array_position(v, t) - 1).cast("int"))))


def differences(a) -> Column:
    """a[i] - a[i-1] from the second element on."""
    a = col(a)
    return F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i))
