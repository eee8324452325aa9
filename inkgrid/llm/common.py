"""Shared ground of the pipeline operators: sessions, shared storage, text batches, gapless numbering."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be long, so batches stay far below Spark's default.
BATCH_ROWS = 2000
#: Rows numbered inside one window partition, and blocks of rows whose sizes are summed up in one.
BLOCK_ROWS, BLOCK_SPAN = 2_000, 4096


def prepare(spark: SparkSession) -> SparkSession:
    """Lower the Arrow batch size unless the user has set one below it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """A folder of intermediate tables in the shared checkpoint folder.

    Tables written here cut lineage: a lost executor costs its running tasks, never the stages before. The folder is
    deleted when the driver's JVM ends; ``close`` deletes it earlier, once nothing reads it any more.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            # in local runs and tests driver and executors share this machine
            Store._own = Store._own or tempfile.mkdtemp(prefix="inkgrid-")
            base = f"file://{Store._own}"
        self.spark, self.root = spark, f"{base.rstrip('/')}/inkgrid/{name}-{uuid.uuid4().hex[:12]}"
        fs, path = self._at()
        fs.deleteOnExit(path)

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        fs, path = self._at(name)
        fs.delete(path, True)

    def close(self) -> None:
        """Delete all tables of this store."""
        fs, path = self._at()
        fs.delete(path, True)


#: Bytes that a cache of a worker holds, by the sizes of its keys and values and what a dictionary takes for them.
CACHE_BYTES = 40 << 20
_CACHES: list[dict] = []
_LAST: list[object] = [None]


class Recent(dict):
    """What ``make`` gave for the keys met of late (bytes or whole numbers for bytes), within about ``budget`` bytes.

    When half of the budget is used, the keys not met since the last such time are forgotten. Large entries are not kept.
    """

    def __init__(self, make: Callable, budget: int = CACHE_BYTES):
        super().__init__()
        self.make, self.half, self.used, self.old = make, budget // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = len(key) + 210 if type(value) is int else len(key) + len(value) + 180  # with what Python adds to both and a dictionary to the entry
        if size <= 512:
            self[key] = value
            self.used += size
            if self.used > self.half:
                self.old, self.used = dict(self), 0
                self.clear()
        return value


def worker_cache(cache: dict) -> dict:
    """A dictionary that Python workers keep between tasks of one operator."""
    _CACHES.append(cache)
    return cache


def use_only(cache: dict | None) -> None:
    """Empty what other operators have left in this worker, which serves one stage after another, and hand its memory back."""
    if _LAST[0] is cache and cache is not None:
        return
    full = [other for other in _CACHES if other is not cache and other]
    for other in full:
        other.clear()
    _LAST[0] = cache
    if full:
        release()


def release() -> None:
    """Return memory that this process has freed but still holds to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)


def cut(batch: pa.RecordBatch, texts: list[bytes], most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows that hold about ``most`` bytes, one row at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < batch.num_rows:
        yield start, batch.num_rows


def numbered(df: DataFrame, out: str, order: list[str], group: list[str] = (), rows: int | None = None, block: list[str] | None = None, span: int = BLOCK_SPAN) -> DataFrame:
    """Gapless numbers from 0 inside each group (of columns without nulls), without a window over a whole group.

    Rows are dealt to hash blocks of about BLOCK_ROWS by ``block`` (default: ``order``); a row's number is the rows of
    its group in earlier blocks plus its place in its own block, by ``order``. Where there are more than ``span``
    blocks, their sizes are summed up by spans first. ``df`` is read twice (and once more to
    count it), so it should be a stored table. The numbers depend only on the rows, ``order`` and ``block``.
    """
    group = list(group)
    n = df.count() if rows is None else rows
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    key = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in block or order))
    df = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    by = [*group, "_block"]
    starts = running(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "_n", "_start", "_block", group, span if blocks > span else None)
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return df.join(starts.drop("_n"), by).withColumn(out, (F.col("_start") + F.col("_place")).cast("long")).drop("_block", "_place", "_start")


def running(sums: DataFrame, value: str, out: str, block: str, group: list[str] = (), span: int | None = BLOCK_SPAN) -> DataFrame:
    """``out``: the sum of ``value`` over the blocks of the group before this one, summed up by spans of blocks first."""
    group = list(group)
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if span is None:
        return sums.withColumn(out, F.coalesce(F.sum(value).over(before(group, block)), F.lit(0)))
    sums = sums.withColumn("_span", F.floor(F.col(block) / span))
    spans = sums.groupBy(*group, "_span").agg(F.sum(value).alias("_span_sum"))
    spans = spans.withColumn("_spans_before", F.coalesce(F.sum("_span_sum").over(before(group, "_span")), F.lit(0))).drop("_span_sum")
    inside = sums.withColumn(out, F.coalesce(F.sum(value).over(before([*group, "_span"], block)), F.lit(0)))
    return inside.join(spans, [*group, "_span"]).withColumn(out, F.col(out) + F.col("_spans_before")).drop("_span", "_spans_before")
