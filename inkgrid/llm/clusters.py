"""Exact k-means on whole numbers, with zone maps of blocks along a Hilbert curve.

Vectors are scaled and floored to whole numbers. They are sorted once along a Hilbert curve through their leading
principal axes and cut into blocks, each with the least and the largest value of every component. The difference of a
point's squared distances to two centroids is linear in the point, so a block's box bounds it exactly: a centroid is no
candidate of a block where some other centroid is nearer at every point of the box. The remaining candidates are
compared with all vectors of the block at once, in whole numbers that a double holds exactly (64-bit integers where it
might not).

The axes are fitted on at most ``sample`` vectors and decide the order only; no result depends on them. Sums of a
cluster's vectors are added up in each task, then by Spark in 38 digits; only centroids pass through the driver.

Defined results: vectors that are null, hold null or non-finite components or have another number of components are
left out, and so are those with a component beyond 2^27 after scaling (their distances would not fit 64 bits). Rows
with a null vec_id are clustered but start no centroid; rows that repeat a vec_id are rows of their own (ties between
them go by their components). With fewer vectors than centroids each vector starts one. An empty table gives an empty
table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, batches

#: Largest component in size; 64 squared differences of such stay below 2^63.
LARGEST = 1 << 27
#: Vectors of a block, vectors from which the axes are fitted, axes of the curve and bits of each.
BLOCK, SAMPLE, AXES, BITS = 128, 4096, 6, 10


def whole_numbers(docs: DataFrame, size: int, scale: float) -> DataFrame:
    """vec_id and raw (floor(scale * component), little-endian 32-bit) of the vectors that are kept."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            v = batch.column("embedding")
            n = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            x = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            end = np.cumsum(n)
            here = np.nonzero(n == size)[0]
            x = x[(end[here] - size)[:, None] + np.arange(size)] if len(here) else np.empty((0, size))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale)
                good = (np.abs(x) <= LARGEST).all(1)  # false for what is not a number
            rows = x[good].astype("<i4")
            raw = [r.tobytes() for r in rows]
            yield pa.record_batch([batch.column("vec_id").take(pa.array(here[good])), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return docs.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, raw binary")


def _matrix(raw: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(-1, size).astype(np.int64)


# -- order ---------------------------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2^bits (bits times columns is 62 at most)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # undo the turns of the curve from the coarsest square to the finest: exchange or reflect the lower bits
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


def axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading principal axes of the sample, and the least and largest value on each."""
    apart = sample - sample.mean(0)
    lead = np.linalg.eigh(apart.T @ apart)[1][:, ::-1][:, :AXES]
    at = sample @ lead
    return lead, at.min(0), at.max(0)


def zones(vectors: DataFrame, size: int, sample: int) -> DataFrame:
    """Blocks along the curve: ids, raw (all vectors), low and high (the box)."""
    found = vectors.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(sample).collect()
    lead, least, most = axes(_matrix([bytes(r.raw) for r in found], size).astype(float)) if found else (np.eye(size)[:, :AXES], np.zeros(AXES), np.ones(AXES))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            at = (_matrix(batch.column("raw").to_pylist(), size) @ lead - least) / np.maximum(most - least, 1e-9)
            cells = np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(hilbert(cells, BITS))], ["vec_id", "raw", "place"])

    def block(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            x = np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<i4").reshape(-1, size)
            rows = [[], [], [], []]
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                for out, value in zip(rows, (batch.column("vec_id")[a : a + BLOCK].to_pylist(), part.tobytes(), part.min(0).tobytes(), part.max(0).tobytes())):
                    out.append(value)
            yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], ["ids", "raw", "low", "high"])

    # a range never holds more than its share of equal vectors: their ids' hashes part them
    dealt = vectors.mapInArrow(place, "vec_id long, raw binary, place long").repartitionByRange("place", F.xxhash64("vec_id"))
    return dealt.sortWithinPartitions("place", "raw").select("vec_id", "raw").mapInArrow(block, "ids array<long>, raw binary, low binary, high binary")


# -- assignment ----------------------------------------------------------------------------------


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box, in whole numbers throughout."""
    # twice the middle of the box, so that it is whole
    rival = int(np.argmin(((low + high - 2 * centroids).astype(float) ** 2).sum(1)))
    slope = 2 * (centroids[rival] - centroids)
    # the least of |x - c|^2 - |x - rival|^2 = slope x + |c|^2 - |rival|^2 over the box
    least = np.where(slope > 0, slope * low, slope * high).sum(1) + (centroids * centroids).sum(1) - (centroids[rival] ** 2).sum()
    return np.nonzero(least <= 0)[0]


def nearest(x: np.ndarray, centroids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (the smallest of equals) and squared distance of the nearest of ``some`` centroids, exactly."""
    c = centroids[some]
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * 4 * x.shape[1] < 1 << 53:
        y, d = x.astype(float), c.astype(float)
        far = (y * y).sum(1)[:, None] - 2 * (y @ d.T) + (d * d).sum(1)
    else:
        far = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    at = far.argmin(1)
    return some[at], far[np.arange(len(x)), at].astype(np.int64)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors, clusters and distances of each block."""
    size = centroids.shape[1]
    for ids, raw, low, high in zip(*(batch.column(c) for c in ("ids", "raw", "low", "high"))):
        x = np.frombuffer(raw.as_py(), "<i4").reshape(-1, size).astype(np.int64)
        box = (np.frombuffer(side.as_py(), "<i4").astype(np.int64) for side in (low, high))
        yield ids, x, *nearest(x, centroids, candidates(*box, centroids))


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """For each cluster with vectors: how many it has, then the sum of each component."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        total = np.zeros((k, size + 1), np.int64)
        for batch in batches(it):
            for _, x, at, _ in _assigned(batch, centroids):
                one = np.zeros((k, len(x)), np.int64)
                one[at, np.arange(len(x))] = 1
                total[:, 0] += one.sum(1)
                total[:, 1:] += one @ x
        at, part = np.nonzero(np.broadcast_to(total[:, :1] > 0, total.shape))
        yield pa.record_batch([pa.array(at), pa.array(part), pa.array(total[at, part])], ["cluster", "part", "n"])

    found = blocks.mapInArrow(run, "cluster long, part long, n long").groupBy("cluster", "part").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(found, key=lambda r: (r.cluster, r.part)):
        out.setdefault(r.cluster, []).append(int(r.n))
    return out


def clustered(docs: DataFrame, store: Store, clusters: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, seed: int = 1, sample: int = SAMPLE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    if clusters < 1 or rounds < 0 or not 1 <= size <= 64:
        raise ValueError("clusters is at least 1, rounds at least 0, size in 1 to 64")
    spark = docs.sparkSession
    vectors = store.put(whole_numbers(docs, size, scale), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(mark, "raw").limit(clusters).collect()
    if not first:  # no vector, or none with an id: nothing starts a centroid
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _matrix([bytes(r.raw) for r in first], size)
    blocks = store.put(zones(vectors, size, sample), "blocks")
    for _ in range(rounds):
        for at, (n, *total) in sums(blocks, centroids).items():
            centroids[at] = [t // n for t in total]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            for ids, _, at, far in _assigned(batch, centroids):
                yield pa.record_batch([ids.values, pa.array(at, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    found = store.put(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "found")
    by = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fit = lambda n: n if n < 1 << 63 else None
    known = spark.createDataFrame([(at, fit(n), fit(sum(by.values())), digest[at]) for at, n in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each cluster
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
