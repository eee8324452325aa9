"""Importance resampling towards the distribution of target texts.

Texts become bags of hashed features: every run of one and of two consecutive words, in the bucket of its CRC-32.
Checksums of all features of a batch come from one table of byte terms by distance from the end (``spans``). Two
histograms, of the corpus and of the target, give each bucket a gain, the logarithm of the ratio of its smoothed
shares; a text's weight is the mean gain of its features, and texts are drawn without replacement by weight plus
keyed Gumbel noise, highest scores first.

Histograms are summed in each task before the shuffle, so what is gathered is bounded by the number of buckets.
Places in the draw come from ranges of scores: tasks number their own range, and only the sizes of ranges are gathered.

Defined results: null text has no words; a text without words has no features and weight 0; texts with fewer than
``least_words`` words are never drawn. A row with a null doc_id has the noise of an empty number and is drawn after
others of the same score. Rows that repeat a doc_id are weighed and drawn each for itself. An empty corpus gives an
empty table, an empty target a uniform one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, as_bytes, batches, cut, use_only
from .spans import Words, crc32_spans, pieces


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each feature: the words not counted before, then all pairs of neighbours."""
    new, two = words.fresh(), words.pairs()
    start = np.concatenate([words.start[new], words.start[two]])
    length = np.concatenate([words.length[new], words.start[two + 1] + words.length[two + 1] - words.start[two]])
    row = np.concatenate([words.row[new], words.row[two]])
    return (crc32_spans(words.buffer, start, length) % np.uint32(buckets)).astype(np.int64), row


def histogram(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: features of all texts in each bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(None)
        n = np.zeros(buckets, np.int64)
        for batch in batches(it):
            texts = as_bytes(batch.column("text"))
            for a, b in cut(batch, texts):
                for words in pieces(texts[a:b]):
                    n += np.bincount(features(words, buckets)[0], minlength=buckets)
        some = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln(ratio of smoothed shares)) of each bucket."""
    big, small = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * big / ((corpus.get(b, 0) + 1.0) * small)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean of gains) of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(None)
        for batch in batches(it):
            texts, k = as_bytes(batch.column("text")), batch.num_rows
            n_words, n, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
            for a, b in cut(batch, texts):
                for words in pieces(texts[a:b]):
                    bucket, row = features(words, len(gain))
                    n_words[a:b] += np.bincount(words.row[words.fresh()], minlength=b - a)
                    n[a:b] += np.bincount(row, minlength=b - a)
                    # gains are whole numbers, and far below 2^53 in sum
                    total[a:b] += np.bincount(row, gain[bucket], b - a).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, (n_words, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Keyed Gumbel noise in thousandths: floor(-1000 ln(-ln u)), u from SHA-256 of the seed and the number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, order: list[Column], out: str, store: Store) -> DataFrame:
    """``rows`` with gapless places from 1 in ``order``: ranges are dealt out, numbered each by its task and added up."""
    schema = rows.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches(it):
            k = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.full(k, part)), pa.array(np.arange(n + 1, n + k + 1))], [*schema.names, "_part", "_place"])
            n += k

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    placed = store.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, _part long, _place long"), f"{out}-places")
    # one row for each range
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(out, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def resampled(docs: DataFrame, target: DataFrame, store: Store, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it is not drawn), n_words.

    Of the documents with ``least_words`` words or more, ``percent`` per cent are drawn, rounded down.
    """
    if not 0 <= percent <= 100 or buckets < 1:
        raise ValueError("percent is in 0 to 100, buckets at least 1")
    corpus, wanted = ({r.bucket: r.n for r in histogram(t, buckets).collect()} for t in (docs, target))
    rows = weights(docs, gains(corpus, wanted, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = store.put(rows.select("doc_id", "n_features", "weight", "score", "n_words"), "weights")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    first = ranked(rows.where(able), order, "rank", store).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = first.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
