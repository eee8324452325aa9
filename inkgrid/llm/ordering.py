"""Training-order materialisation.

Every sequence has an index, gapless over the whole corpus: the sequences in the order in which the tokenising tasks
read the documents. A keyed Feistel permutation of the index gives its global slot; where the network's domain (a power
of four) is larger than the corpus, results outside are permuted again until they fall inside (cycle-walking), so slots
are gapless too. Ids are shuffled once, by ranges of slots: a shard holds a run of slots in order, as records of one
fixed stride, so slot i is found by arithmetic and reading can resume anywhere.

A record is the sequence's number of tokens (32 bits), its ids, zeros up to the sequence length (all little-endian, an
id in two bytes if the vocabulary allows, else four) and one line feed (the separator of Spark's text writer, which
writes the shards to any file system Spark knows).

Defined results: null text is empty and one sequence (its end token); rows that repeat an id are sequences of their
own; an empty table gives no slot; extra columns are ignored. Slots depend on the key, on the documents and on how the
input's files are split for reading; once the pieces are stored, lost tasks can't change them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, batches
from .packing import PART_BITS, id_width, pieces

ROUNDS = 6
#: Bytes of records that one task deals out at least, where there are so many.
TASK_BYTES = 64 << 20
#: Bytes that are read from a shard at once.
READ_BYTES = 1 << 20


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of indices below n: a permutation of 0..n-1 for each key."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    low, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    walk = np.arange(len(out))
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1) for r in range(1, rounds + 1)]
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (_scramble(right, k) & low)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def stride(length: int, width: int = 4) -> int:
    return 4 + width * length + 1


def ordered(docs: DataFrame, store: Store, path: str, length: int = 512, shard_rows: int = 16_384, key: int = 20_240_607) -> DataFrame:
    """One row per sequence: slot, shard, row (in the shard), doc_id, piece, length, record (without the line feed), dealt and sorted by shard and slot."""
    width = id_width(path)
    found = store.put(pieces(docs, path, length, width), "pieces")
    counts = found.groupBy(F.shiftright("row", PART_BITS).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    starts, n = {}, 0
    for r in sorted(counts.collect()):  # one number for each task that has tokenised
        starts[r.part] = n
        n += r.c
    shared = docs.sparkSession.sparkContext.broadcast(starts)
    names = ["slot", "shard", "row", "doc_id", "piece", "length"]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            row, size = batch.column("row").to_numpy(), batch.column("length")
            part, group = np.unique(row >> PART_BITS, return_inverse=True)
            index = np.array([shared.value[p] for p in part.tolist()], np.int64)[group] + (row & ((1 << PART_BITS) - 1))
            slot = permute(index, n, key)
            heads = size.to_numpy().astype("<u4").tobytes()
            body = [heads[4 * i : 4 * i + 4] + x for i, x in enumerate(batch.column("ids").to_pylist())]
            cols = [pa.array(slot), pa.array(slot // shard_rows), pa.array(slot % shard_rows), batch.column("doc_id"), batch.column("piece"), size, pa.array(body, pa.binary())]
            yield pa.record_batch(cols, [*names, "body"])

    slots = found.select("row", "doc_id", "piece", "length", "ids").mapInArrow(place, "slot long, shard long, row long, doc_id long, piece int, length long, body binary")
    # each task gets whole shards, a range of slots
    each = max(1, TASK_BYTES // (stride(length, width) * shard_rows))
    tasks = max(1, -(-n // (shard_rows * each)))
    dealt = slots.repartitionById(tasks, F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("shard", "slot")
    return dealt.select(*names, F.rpad("body", stride(length, width) - 1, F.lit(b"\0")).alias("record"))


def write_shards(rows: DataFrame, folder: str, path: str, length: int, shard_rows: int) -> None:
    """Write ``ordered`` rows as fixed-stride shards, one file in ``folder/shard=K`` each, and a manifest."""
    width = id_width(path)
    records = rows.select("shard", F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").partitionBy("shard").text(folder)
    manifest = json.dumps({"length": length, "width": width, "stride": stride(length, width), "shard_rows": shard_rows})
    rows.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}_manifest")


def read_slots(spark: SparkSession, folder: str, start: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from ``start`` on: what a resumed training run reads. Only the bytes of these slots are read."""
    m = json.loads(spark.read.text(f"{folder}_manifest").first().value)
    step, rows, kind = m["stride"], m["shard_rows"], f"<u{m['width']}"
    jvm, slot, end = spark.sparkContext._jvm, start, None if count is None else start + count
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while end is None or slot < end:
        files = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={slot // rows}/part-*"))
        if not files:  # the corpus ends here
            return
        held = files[0].getLen() // step
        last = min(held, rows if end is None else end - slot + slot % rows)
        stream = fs.open(files[0].getPath())
        try:
            while (at := slot % rows) < last:
                n = min(last - at, max(1, READ_BYTES // step))
                stream.seek(at * step)
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n * step))
                for k in range(0, n * step, step):
                    yield slot, np.frombuffer(data, kind, int.from_bytes(data[k : k + 4], "little"), k + 4)
                    slot += 1
                if slot % rows == 0:
                    break
        finally:
            stream.close()
        if held < rows:
            return
