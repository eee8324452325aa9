"""Balanced label propagation: linked documents gather in shards whose sizes stay even.

Every linked document starts in a shard that the hash of its own id gives. Rounds of joins count each document's
neighbours by shard; documents ask to move to the shard that holds most of them, half of the documents (by a hash of
the id and the round) in each round. Requests between two shards that go both ways are exchanged, others are granted as far as the
shard's quota has room, so a group that is larger than a quota fills one shard and keeps the rest where it is. At the
end every shard takes exactly its quota of rows: what is over, and the documents without links, fills the shards that
have room.

Laws: ``rows`` (counts at most one apart, links respected as far as that allows) and ``key`` (id and number of shards
decide, links are ignored; one more shard takes rows only into itself).

Defined results: a null text has size 1; rows that repeat an id get a slot each (in one shard under ``key``); rows with
a null id are placed like documents without links; links with a null or unknown end, and self links, are ignored; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, numbered


def key_shard(key: Column, shards: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the id is largest."""
    each = F.array(*(F.struct(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)))
    return F.array_max(each)["s"]


def text_links(docs: DataFrame, store: Store, shards: int = 16) -> DataFrame:
    """Links (a, b) that join documents with the same text; ``docs`` has id, h1 and h2 (hashes of the text by two seeds).

    A document is linked to the smallest id in its part of the text's documents (a hash of the id deals them into as
    many parts as there are shards, so that each part fits into one), a part's smallest id to the smallest of all.
    """
    parts = docs.where("id is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(shards)))
    hubs = parts.groupBy("h1", "h2", "part").agg(F.min("id").alias("b"), F.max("id").alias("_top"))
    hubs = store.put(hubs, "hubs")  # then the join reads both sides as they are and a hot text can be split
    near = parts.join(hubs.where("_top > b"), ["h1", "h2", "part"]).where("id > b").select(F.col("id").alias("a"), "b")
    tops = hubs.groupBy("h1", "h2").agg(F.min("b").alias("top"), F.max("b").alias("_last")).where("_last > top")
    far = hubs.join(tops, ["h1", "h2"]).where("b > top").select(F.col("b").alias("a"), F.col("top").alias("b"))
    return near.unionByName(far)


def first_shard(key: Column, shards: int) -> Column:
    """Where a linked document starts."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(shards)).cast("int")


def cut_edges(links: DataFrame, placed: DataFrame) -> int:
    """How many links ``(a, b)`` have their ends in different shards of ``placed(id, shard)`` with distinct ids."""
    a, b = (placed.select(F.col("id").alias(c), F.col("shard").alias(f"_{c}")) for c in "ab")
    return links.join(a, "a").join(b, "b").where("_a <> _b").count()


def granted(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the moves asked for (from, to) may go: as many as come back, and more where there is room."""
    out = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    for (a, b), n in sorted(asked.items()):
        more = min(n - out[a, b], room[b])
        out[a, b] += more
        room[b] -= more
    return out


def balanced_shards(nodes: DataFrame, links: DataFrame, store: Store, shards: int = 16, rounds: int = 6) -> DataFrame:
    """``nodes(id, row)`` with distinct ``row`` -> (id, row, shard), counts at most one apart."""
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = store.put(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = both.select("a").distinct()
    base = nodes.join(linked, nodes["id"] == linked["a"], "left").select("id", "row", F.col("a").isNotNull().alias("linked"))
    base = store.put(base.withColumn("shard", F.when(F.col("linked"), first_shard(F.col("id"), shards))), "place0")
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    spark, still, last = nodes.sparkSession, 0, "place0"

    for k in range(1, rounds + 1):
        load = {r.shard: r["count"] for r in base.where("linked").groupBy("shard").count().collect()}
        labels = base.where("linked").groupBy("id").agg(F.min("shard").alias("shard"))
        votes = both.join(labels.select(F.col("id").alias("b"), F.col("shard").alias("to")), "b").groupBy("a", "to").agg(F.count(F.lit(1)).alias("v"))
        votes = votes.join(labels.select(F.col("id").alias("a"), F.col("shard").alias("at")), "a")
        best = votes.groupBy("a", "at").agg(F.max(F.struct("v", -F.col("to"))).alias("x"), F.max(F.when(F.col("to") == F.col("at"), F.col("v")).otherwise(0)).alias("own"))
        best = best.where("x.v > own").select("a", "at", (-F.col("x.col2")).cast("int").alias("to"))
        moves = store.put(best.where(F.pmod(F.xxhash64("a", F.lit(k)), F.lit(2)) == 0), f"moves{k}")
        asked = {(r["at"], r.to): r["count"] for r in moves.groupBy("at", "to").count().collect()}  # at most shards^2
        limit = granted(asked, {s: max(0, quota[s] - load.get(s, 0)) for s in range(shards)})
        still = 0 if any(limit.values()) else still + 1
        if still == 3:  # no half moves any more
            break
        if still:
            continue
        if limit != asked:  # else all may go
            limits = spark.createDataFrame([(a, b, c) for (a, b), c in limit.items()], "at int, to int, room long")
            moves = numbered(moves, "_i", ["a"], ["at", "to"], rows=sum(asked.values())).join(F.broadcast(limits), ["at", "to"]).where("_i < room")
        moved = base.join(moves.select(F.col("a").alias("_a"), F.col("to").alias("_to")), F.col("id") == F.col("_a"), "left")
        base = store.put(moved.withColumn("shard", F.coalesce("_to", "shard")).select(*base.columns), f"place{k}")
        store.drop(last)
        last = f"place{k}"

    # exact quotas: what is over, and documents without links, go where there is room
    ranked = numbered(base.where("linked"), "_i", ["row"], ["shard"])
    limit = spark.createDataFrame(list(enumerate(quota)), "shard int, quota long")
    ranked = store.put(ranked.join(F.broadcast(limit), "shard").select("id", "row", "shard", (F.col("_i") < F.col("quota")).alias("stays")), "ranked")
    stay = ranked.where("stays").select("id", "row", "shard")
    load = {r.shard: r["count"] for r in stay.groupBy("shard").count().collect()}
    free = store.put(ranked.where("not stays").select("id", "row").unionByName(base.where("not linked").select("id", "row")), "free")
    first, cuts = 0, []
    for s in range(shards):
        cuts.append(F.struct(F.lit(first).cast("long").alias("at"), F.lit(s).alias("s")))
        first += quota[s] - load.get(s, 0)
    ends = F.array(*(c for c in cuts))
    fill = numbered(free, "_i", ["row"]).withColumn("shard", F.array_max(F.filter(F.transform(ends, lambda e: F.when(e["at"] <= F.col("_i"), e)), lambda e: e.isNotNull()))["s"])
    return stay.unionByName(fill.select("id", "row", "shard"))


def shard_documents(docs: DataFrame, store: Store, shards: int = 16, law: str = "rows") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard; equal texts are linked."""
    if law not in ("rows", "key"):
        raise ValueError("the law is rows or key")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(2_654_435_761), text).alias("h2"))
    base = store.put(base.withColumn("row", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string"))), "base")
    if law == "key":
        placed = base.select("id", "row", key_shard(F.col("id"), shards).alias("shard"), key_shard(F.col("id"), shards + 1).alias("grown_shard"))
    else:
        placed = balanced_shards(base.select("id", "row"), text_links(base.select("id", "h1", "h2"), store, shards), store, shards).withColumn("grown_shard", F.lit(None).cast("int"))
    placed = store.put(placed, "placed")
    slots = numbered(placed, "slot", ["row"], ["shard"])
    out = base.select("id", "row", "size", "text_crc32").join(slots.drop("id"), "row")
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")
