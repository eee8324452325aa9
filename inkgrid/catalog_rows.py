"""Kernels on the rows of a batch, for registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Rows of a result given on at once: pictures are much larger than the rows they come from.
GIVEN = 512


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores, where a kernel takes much longer than a row's way there."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def by_row(df: DataFrame, schema: str, kernel: Callable[..., tuple]) -> DataFrame:
    """The key and what a NumPy kernel makes of the other columns, batch by batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for lo in range(0, len(pdf), GIVEN):
                rows = [(r[0], *kernel(*r[1:])) for r in pdf[lo : lo + GIVEN].itertuples(index=False)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return df.mapInPandas(run, schema)


def _square(v, *shape: int) -> np.ndarray:
    return np.asarray(v, np.uint8)[: int(np.prod(shape))].reshape(shape)


def _joined(a: np.ndarray) -> str:
    return ",".join(map(str, a.ravel().tolist()))
