"""Near-deduplication of embeddings by PCA-ordered, tiled comparison.

Unit vectors are turned into the axes of a principal component analysis, leading axis first. Two vectors with
cosine c are sqrt(2 - 2c) apart, so links lie within that distance on every axis: vectors are dealt by label and
by squares of that width on the two axes along which they differ most, each square compared with itself and with its
neighbours. Inside a task they are sorted along the
first axis and compared tile by tile; products accumulate over the leading axes first, and a pair is dropped as soon
as its product so far plus the product of its remaining norms cannot reach the threshold. Every bound is exact, so
the axes (fitted on a bounded sample) only decide how early pairs stop, never which pairs link.

Equal vectors of a label are compared once and counted as often as they occur; a task returns counts and a spanning
forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a
label, link with nothing (n_links 0, own component, kept). Vectors of different length do not link. A row with a
null vec_id links with nothing, has a null component and is kept. Rows that repeat a vec_id share its links and its
component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, batches
from .components import components
from .near_dedup import blocks, forest, tiled, _sides

#: Vectors from which the axes are fitted.
SAMPLE = 4096
TILE = 512
#: Axes added at each step.
STEP = 8


def _vectors(docs: DataFrame) -> DataFrame:
    """vec_id, label and raw (components as little-endian doubles; null where the vector links with nothing)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            v = batch.column("embedding")
            size = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            x = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # a null component is not a number; -0.0 and 0.0 are the same
            end = np.cumsum(size)
            bad, some = (np.concatenate([[0], np.cumsum(y)]) for y in (~np.isfinite(x), x != 0))
            good = (bad[end] == bad[end - size]) & (some[end] > some[end - size])
            for c in ("vec_id", "label"):
                good &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            data = x.astype("<f8").tobytes()
            raw = [data[8 * (e - n) : 8 * e] if g else None for e, n, g in zip(end.tolist(), size.tolist(), good.tolist())]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])

    docs = docs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return docs.mapInArrow(run, "vec_id long, label string, raw binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector, from the ``sample`` vectors with the smallest id hashes: the principal axes for products (of what the vectors are) and the two leading ones for slices (of how they differ from their mean)."""
    rows = vectors.select("raw").orderBy(F.xxhash64("vec_id"), "raw").limit(sample).collect()
    by: dict[int, list[bytes]] = {}
    for r in rows:
        by.setdefault(len(r.raw) // 8, []).append(bytes(r.raw))
    out = {}
    for d, raw in by.items():
        u = _unit(raw)
        apart = u - u.mean(0)
        out[d] = tuple(np.ascontiguousarray(np.linalg.eigh(m.T @ m)[1][:, ::-1]) for m in (u, apart))
        out[d] = out[d][0], out[d][1][:, : min(2, d)]
    return out


def cells(raw: list[bytes], turn: dict[int, tuple[np.ndarray, np.ndarray]], reach: float) -> np.ndarray:
    """Slice of each vector on both axes (0 on the second where there is one component only)."""
    out = np.zeros((len(raw), 2), np.int32)
    sizes = np.array([len(r) for r in raw])
    for n in np.unique(sizes).tolist():
        here = np.nonzero(sizes == n)[0]
        d = n // 8
        lead = turn[d][1] if d in turn else np.eye(d)[:, :2]
        out[here, : lead.shape[1]] = np.floor(_unit([raw[i] for i in here.tolist()]) @ lead / reach)
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, cosine: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose product may reach ``cosine``; rows are unit vectors on principal axes."""
    d, floor = x.shape[1], cosine - 1e-9
    after = lambda z, k: np.sqrt(np.maximum((z[:, k:] ** 2).sum(1), 0))
    k = min(step, d)
    got = x[:, :k] @ y[:, :k].T
    i, j = np.nonzero(got + np.outer(after(x, k), after(y, k)) >= floor)
    if len(i) > got.size // 8:  # most pairs go on: one product is cheaper than many picks
        return np.nonzero(x @ y.T >= floor)
    got = got[i, j]
    while k < d and len(i):
        n = min(k + step, d)
        got = got + np.einsum("ij,ij->i", x[i, k:n], y[j, k:n])
        ok = got + after(x, n)[i] * after(y, n)[j] >= floor
        i, j, got, k = i[ok], j[ok], got[ok], n
    return i, j


def _pairs_in_order(x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) from left x right, tile by tile along the first axis, tiles out of reach skipped."""
    left, right = left[np.argsort(x[left, 0], kind="stable")], right[np.argsort(x[right, 0], kind="stable")]
    for a in range(0, len(left), TILE):
        one = left[a : a + TILE]
        lo = np.searchsorted(x[right, 0], x[one[0], 0] - reach)
        hi = np.searchsorted(x[right, 0], x[one[-1], 0] + reach, "right")
        for b in range(int(lo), int(hi), TILE):
            two = right[b : min(b + TILE, int(hi))]
            i, j = close_pairs(x[one], x[two], cosine)
            yield one[i], two[j]


def embedding_groups(docs: DataFrame, store: Store, cosine: float = 0.98, cap: int = 4000, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (see the module's docstring)."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine is in (0, 1]")
    vectors = store.put(_vectors(docs), "vectors")
    usable = vectors.where("raw is not null")
    same = store.put(usable.groupBy("label", "raw").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")), "same")
    turn = axes(usable, sample)
    reach = math.sqrt(2 - 2 * cosine) + 1e-6
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(turn)  # a square matrix and two axes for each length of vector in the sample

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            raw = batch.column("raw").to_pylist()
            where = cells(raw, shared.value, reach)
            yield pa.record_batch([*batch.columns, pa.array([len(r) // 8 for r in raw], pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in where.T)], [*batch.schema.names, "d", "x", "y"])

    rows = same.select("label", "raw", "id", "w").mapInArrow(place, "label string, raw binary, id long, w long, d int, x int, y int")
    # a square is at home in itself and visits four of its neighbours: of two neighbours, one visits the other
    to = [F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(dx == dy == 0).alias("home")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]
    rows = rows.withColumn("_s", F.explode(F.array(*to))).select("label", "d", "raw", "id", "w", F.col("_s.x").alias("x"), F.col("_s.y").alias("y"), F.col("_s.home").alias("home"))
    # a visitor that meets nobody at home has come in vain
    settled = rows.where("home").select("label", "d", "x", "y").distinct()
    rows = rows.join(settled, ["label", "d", "x", "y"], "left_semi")

    def link(t: pa.Table, at: tuple):
        raw, home = t.column("raw").to_pylist(), t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        w, ids = t.column("w").to_numpy(), t.column("id").to_numpy()
        u = _unit(raw)
        x = u @ (shared.value[u.shape[1]][0] if u.shape[1] in shared.value else np.eye(u.shape[1]))
        left, right = _sides(t, at)
        own = at[-2] == at[-1]
        links, ii, jj = np.zeros(t.num_rows, np.int64), [], []
        for i, j in _pairs_in_order(x, left, right, cosine, reach):
            ok = (home[i] | home[j]) & ((i != j) if not own else np.where(home[i] == home[j], i < j, home[i]))
            i, j = i[ok], j[ok]
            dot = np.empty(len(i))
            for lo in range(0, len(i), 1 << 16):
                y = slice(lo, lo + (1 << 16))
                dot[y] = np.einsum("ij,ij->i", u[i[y]], u[j[y]])
            ok = dot >= cosine
            i, j = i[ok], j[ok]
            np.add.at(links, i, w[j])
            np.add.at(links, j, w[i])
            node, root = forest(t.num_rows, i, j)
            ii.append(node)
            jj.append(root)
        node, root = forest(t.num_rows, np.concatenate(ii), np.concatenate(jj)) if ii else (np.empty(0, np.int64),) * 2
        some = np.nonzero(links)[0]
        # links (a, b), and counts as (a, -1 - count)
        return np.concatenate([ids[node], ids[some]]), np.concatenate([ids[root], -1 - links[some]]), np.concatenate([np.zeros(len(node), bool), np.ones(len(some), bool)])

    keys = ["label", "d", "x", "y"]
    found = store.put(blocks(tiled(rows, keys, F.col("id"), cap), keys, link, counted=True), "found")
    comp = components(found.where("not counted").select("a", "b"), store)
    counts = found.where("counted").groupBy(F.col("a").alias("id")).agg(F.sum(-1 - F.col("b")).alias("n"))
    known = same.join(comp, "id", "left").join(counts, "id", "left")
    known = known.select("label", "raw", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = vectors.join(known, ["label", "raw"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
