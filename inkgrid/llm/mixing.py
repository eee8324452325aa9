"""Temperature mixing of sources.

A source's weight is its share of the tokens to the power alpha, normalised. Alpha is found by bisection: the weights
reach the target entropy (a share of the largest possible), flatter than the sources with alpha below 1, sharper with
alpha above 1, but no source is repeated more often than the limit. A
source's budget is realised in blocks: whole passes over its documents, each in an order of its own given by keyed
hashes, and a last pass cut where the next document would exceed the budget. As a pass is a run in hash order, the cut
is one threshold for each source, found from sums over hash ranges; no source is gathered in one task. A weight depends
on a source's tokens alone, so alpha is found on a histogram of these totals with CLASSES classes for each doubling,
each with its mean (where a class holds one total, nothing is lost); sources themselves stay in tables.

Defined results: null text has no tokens; a null source is a source of its own; sources without tokens are drawn once
and have weight 0; rows that repeat an id are drawn together; an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_ROWS, Store, numbered, running


def entropy(weights: list[float], times: list[int] | None = None) -> float:
    return -math.fsum(n * w * math.log(w) for w, n in zip(weights, times or [1] * len(weights)) if w > 0)


def heated(tokens: list[int], alpha: float, times: list[int] | None = None) -> list[float]:
    """The weight of one source of each total, of which there are so many."""
    times = times or [1] * len(tokens)
    most = max(tokens, default=0)  # against the largest, so that no power of all vanishes
    raw = [(t / most) ** alpha if t else 0.0 for t in tokens]
    whole = math.fsum(x * n for x, n in zip(raw, times))
    return [x / whole for x in raw]


#: Classes of a histogram of totals for each doubling, and the largest exponent.
CLASSES, SHARPEST = 1024, 1024.0


@dataclass(frozen=True)
class Mix:
    alpha: float
    weights: list[float]
    budgets: list[int]


def solve(tokens: list[int], budget: int | None, entropy_share: float, most_passes: float, cover: bool = False, times: list[int] | None = None) -> Mix:
    """The mix for sources of so many tokens (``times``: how many sources have each of these totals).

    budget: tokens to draw, by default as many as there are. cover: draw as many as it takes for every document to be
    drawn once; the limit on passes then bounds the largest number of passes over the smallest. Budgets are whole
    tokens; what rounding leaves goes to the largest remainders, as far as all sources of one total can have it.
    """
    times = times or [1] * len(tokens)
    many = sum(n for t, n in zip(tokens, times) if t)
    if not many:
        return Mix(1.0, [0.0] * len(tokens), [0] * len(tokens))
    all_tokens = round(sum(t * n for t, n in zip(tokens, times)))

    def drawn(weights: list[float]) -> float:
        return max(t / w for t, w in zip(tokens, weights) if t) if cover else float(budget if budget is not None else all_tokens)

    def passes(alpha: float) -> float:
        weights = heated(tokens, alpha, times)
        b = drawn(weights)
        return max(b * w / t for t, w in zip(tokens, weights) if t)

    def reached(low: float, high: float, ok) -> float:
        """The exponent nearest to ``low`` between both that is ok, given that ``high`` is and that it is monotonic."""
        if ok(low):
            return low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    if passes(1.0) > most_passes * (1 + 1e-12):
        raise ValueError(f"the budget takes {passes(1.0):.3f} passes over the sources; the limit is {most_passes}")
    target = entropy_share * math.log(many)
    spread = lambda a: entropy(heated(tokens, a, times), times)
    if spread(1.0) <= target + 1e-12:
        end = reached(0.0, 1.0, lambda a: spread(a) <= target)
    else:  # past SHARPEST nothing changes any more but for sources as large as the largest
        end = 1.0
        while end < SHARPEST and spread(end) > target:
            end *= 2
        end = reached(1.0, end, lambda a: spread(a) <= target) if spread(end) <= target else end
    # passes are fewest at 1 and grow to both sides
    alpha = reached(end, 1.0, lambda a: passes(a) <= most_passes * (1 + 1e-12))
    weights = heated(tokens, alpha, times)
    exact = [w * drawn(weights) for w in weights]
    if cover:
        return Mix(alpha, weights, [max(t, math.floor(x + 1e-6)) for t, x in zip(tokens, exact)])
    budgets = [math.floor(x) for x in exact]
    spare = int(round(math.fsum(x * n for x, n in zip(exact, times)))) - sum(b * n for b, n in zip(budgets, times))
    for i in sorted(range(len(exact)), key=lambda i: (budgets[i] - exact[i], i)):
        if times[i] > spare:
            break
        budgets[i] += 1
        spare -= times[i]
    return Mix(alpha, weights, budgets)


def with_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens (words between ASCII white space)."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.cast("long").alias("tokens"))


def _order(seed: int, turn):
    """Place of a document in a pass: a keyed hash, ties (repeated ids) together."""
    return F.xxhash64(F.lit(seed), turn, F.coalesce(F.col("doc_id"), F.lit(-1)))


def plan(docs: DataFrame, store: Store, budget: int | None, entropy_share: float, most_passes: float, cover: bool, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens), and for each source: alpha, weight, passes (whole ones) and last (the hash up to which one more is drawn); both stored."""
    spark = docs.sparkSession
    base = store.put(with_tokens(docs), "tokens")
    totals = store.put(base.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "totals")
    # 64 doublings at most, whatever the number of sources
    kind = F.when(F.col("t") > 0, F.floor(F.log2("t") * CLASSES)).otherwise(-1).cast("long")
    found = sorted((r.k, r.t, r.c, r.n) for r in totals.groupBy(kind.alias("k")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect())
    means = [t // c if t % c == 0 else t / c for _, t, c, _ in found]
    mix = solve(means, budget, entropy_share, most_passes, cover, [c for _, _, c, _ in found])
    rows = [(k, float(mean), mix.alpha, w, b) for (k, *_), mean, w, b in zip(found, means, mix.weights, mix.budgets)]
    known = spark.createDataFrame(rows, "_k long, _mean double, alpha double, _w double, _b long")
    part = F.when(F.col("t") > 0, F.pow(F.col("t") / F.col("_mean"), F.col("alpha"))).otherwise(1.0)
    sources = totals.withColumn("_k", kind).join(F.broadcast(known), "_k").withColumn("_own", F.floor(F.col("_b") * part).cast("long"))
    none = F.col("t") == 0
    sources = sources.select("source", "alpha", (F.col("_w") * part).alias("weight"), F.when(none, 1).otherwise(F.expr("_own div t")).cast("long").alias("passes"), F.when(none, 0).otherwise(F.expr("_own % t")).cast("long").alias("rest"))
    sources = store.put(sources, "weights")
    # hash ranges of about BLOCK_ROWS documents; their order is the order of the hashes
    bits = max(0, min(40, math.ceil(math.log2(max(1, sum(n for *_, n in found) / BLOCK_ROWS)))))
    part = base.join(sources.select(F.col("source").alias("_s"), "passes", "rest"), F.col("source").eqNullSafe(F.col("_s"))).where("rest > 0")
    part = part.withColumn("_h", _order(seed, F.col("passes"))).withColumn("_b", F.shiftright("_h", 63 - bits) if bits else F.lit(0).cast("long"))
    part = part.withColumn("_k", F.coalesce("source", F.lit(""))).withColumn("_z", F.col("source").isNull())
    sums = running(part.groupBy("_k", "_z", "_b").agg(F.sum("tokens").alias("_t")), "_t", "_before", "_b", ["_k", "_z"]).drop("_t")
    part = part.join(sums, ["_k", "_z", "_b"])
    inside = part.withColumn("_run", F.col("_before") + F.sum("tokens").over(Window.partitionBy("_k", "_z", "_b").orderBy("_h"))).where("_run <= rest")
    last = inside.groupBy("_k", "_z").agg(F.max("_h").alias("last")).select(F.when(~F.col("_z"), F.col("_k")).alias("_s"), "last")
    ended = sources.join(last, sources["source"].eqNullSafe(last["_s"]), "left").drop("_s", "rest")
    return base, store.put(ended, "sources")


def _copies(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` with the source's numbers and ``_copies``."""
    sources = sources.withColumnRenamed("source", "_s")
    rows = rows.join(sources, rows["source"].cast("string").eqNullSafe(sources["_s"])).drop("_s")
    return rows.withColumn("_copies", F.col("passes") + F.coalesce((_order(seed, F.col("passes")) <= F.col("last")).cast("long"), F.lit(0)))


def draws(docs: DataFrame, store: Store, budget: int | None = None, entropy_share: float = 0.9, most_passes: float = 4.0, seed: int = 17) -> DataFrame:
    """One row per drawn document and pass: doc_id, source, tokens, pass, position (gapless in the source's pass), weight, alpha."""
    base, sources = plan(docs, store, budget, entropy_share, most_passes, False, seed)
    rows = _copies(base, sources, seed).where("_copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    rows = rows.withColumn("_h", _order(seed, F.col("pass"))).withColumn("_k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = store.put(rows.select("doc_id", "source", "tokens", "pass", "weight", "alpha", "_h", "_k"), "draws")
    out = numbered(rows, "position", ["_h", "doc_id"], ["_k", "pass"])
    return out.select("doc_id", "source", "tokens", "pass", "position", "weight", "alpha")


def mixed(docs: DataFrame, store: Store, entropy_share: float = 0.95, most_passes: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with all its columns: every document once, and as often again as its source's weight asks for."""
    columns = docs.columns
    _, sources = plan(docs, store, None, entropy_share, most_passes, True, seed)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"))
    rows = _copies(packed, sources, seed)
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("_copies", F.lit(1))))).select("_row.*")
