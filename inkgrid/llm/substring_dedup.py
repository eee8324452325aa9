"""Substring deduplication with a log-structured index of window fingerprints.

A window is ``width`` consecutive words of one document. Each window selects the smallest hash among its
``gram``-word hashes (leftmost on ties), so equal windows select the same anchor; consecutive windows with one
anchor form a group, known by the anchor hash and by a hash of all the words the group spans. The index holds one
entry for each different group, with the document where it occurs first: sorted immutable runs, one for each
ingested batch, merged by (anchor, group) with a new batch and compacted when there are too many.

A batch is judged in two steps. A group that also occurs in a document with a smaller id is a repeat as a whole.
Groups that share their anchor but not all their words are compared window by window; there only the first
document of each different group has to be read, at every place where it has the group, for copies in later documents
are repeats already. What a polynomial hash has found (the anchor's, or a single window's) is verified by a BLAKE2b
digest of the words themselves, taken over the whole group or window: a link needs both to agree (128 bits, or 96 for
single windows).

Defined results: null text has no words; rows with a null doc_id keep all words and are no source for others;
rows that repeat an id are one document for the rule "smaller doc_id" and each is judged on its own text; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, Store, as_bytes, batches, cut, use_only, worker_cache

WIDTH, GRAM = 50, 10
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 30) - 1)


_WORDS = worker_cache(Recent(xxhash.xxh64_intdigest))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 21), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Text:
    """Words of several documents end to end, with hashes of any range of them."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.joined: bytes | None = None
        sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.start[-1])
        if n > int(_LOW):
            raise ValueError("a text of over 2^30 words")
        use_only(_WORDS)
        get = _WORDS.__getitem__
        h = np.fromiter((get(w) for ws in self.words for w in ws), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_BACK, n + 1)
        self.size = n

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words from a to before b."""
        return _mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(_BACK))

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """BLAKE2b, 64 bits, of the words themselves from a to before b, one space between them."""
        if self.joined is None:
            self.joined = b" ".join([w for ws in self.words for w in ws])
            self.edge = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for ws in self.words for w in ws), np.int64, self.size))])
        view, digest = memoryview(self.joined), hashlib.blake2b
        out = b"".join([digest(view[x:y], digest_size=8).digest() for x, y in zip(self.edge[a].tolist(), (self.edge[b] - 1).tolist())])
        return np.frombuffer(out, "<u8")


def groups(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Groups of windows: row, first window, number of windows, anchor hash, content hash."""
    t = _Text(texts)
    none = np.empty(0, np.int64)
    if t.size < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(t.size - gram + 1)
    anchors = t.hashes(at, at + gram)
    least, span, over = (anchors & ~_LOW) | at.astype(np.uint64), 1, width - gram + 1
    while span * 2 <= over:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < over:
        least = np.minimum(least[: len(least) - (over - span)], least[over - span :])
    chosen = (least & _LOW).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(t.start))
    valid = np.nonzero(owner[: len(chosen)] == owner[width - 1 :])[0]
    if not len(valid):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.concatenate([[0], np.nonzero(np.diff(chosen[valid]))[0] + 1])
    n = np.diff(np.concatenate([first, [len(valid)]]))
    start = valid[first]
    row = owner[start]
    return row, start - t.start[row], n, anchors[chosen[start]], t.digests(start, start + n - 1 + width)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _crc(texts: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(x) for x in texts], np.int64)


def group_rows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """id, t (CRC-32 of the text), s and n (the group's windows), a (anchor), g (content)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            texts, ids = as_bytes(batch.column("text")), batch.column("doc_id").cast(pa.int64()).to_numpy()
            for lo, hi in cut(batch, texts):
                row, s, n, a, g = groups(texts[lo:hi], width, gram)
                crc = _crc(texts[lo:hi])
                cols = [pa.array(ids[lo:hi][row]), pa.array(crc[row]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), _signed(a), _signed(g)]
                yield pa.record_batch(cols, ["id", "t", "s", "n", "a", "g"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "id long, t long, s int, n int, a long, g long")


def _text_crc():
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


class WindowIndex:
    """Runs of group entries (a, g, first) in a shared store; ``first`` is the smallest (id, t, s, n) of the group."""

    def __init__(self, store: Store, width: int = WIDTH, gram: int = GRAM, max_runs: int = 3):
        if not 0 < gram <= width:
            raise ValueError("gram is between 1 and width")
        self.store, self.width, self.gram, self.max_runs = store, width, gram, max_runs
        self.runs: dict[str, DataFrame] = {}
        self.made = 0

    def _merged(self) -> DataFrame:
        """All runs by (a, g): a plain read if there is one, else one merge."""
        runs = list(self.runs.values())
        return runs[0] if len(runs) == 1 else reduce(DataFrame.unionByName, runs).groupBy("a", "g").agg(F.min("first").alias("first"), F.max("batch").alias("batch"))

    def compact(self) -> None:
        """Merge all runs into one; the old ones go when it is written."""
        if len(self.runs) < 2:
            return
        name = f"run{self.made}c"
        merged = self.store.put(self._merged().sortWithinPartitions("a", "g"), name)
        for old in self.runs:
            self.store.drop(old)
        self.runs = {name: merged}

    def ingest(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Add the documents of ``batch`` and return their repeats: id, t, s, n (windows s to s+n-1).

        Ids must not be below those of earlier batches if their repeats are to be final. ``history`` holds the texts
        of all documents ingested so far, those of ``batch`` included.
        """
        self.made += 1
        k = self.made
        rows = self.store.put(group_rows(batch, self.width, self.gram), f"rows{k}")
        new = rows.groupBy("a", "g").agg(F.min(F.struct("id", "t", "s", "n")).alias("first"), F.max("id").alias("last"))
        run = self.store.put(new.sortWithinPartitions("a", "g").withColumn("batch", F.lit(k)), f"run{k}")
        self.runs[f"run{k}"] = run.drop("last")
        merged = self.store.put(self._merged(), f"merged{k}") if len(self.runs) > 1 else run.drop("last")
        # anchors with several groups, one of them new: their windows are compared one by one
        mixed = merged.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.max("batch").alias("b")).where(f"c > 1 and b = {k}").select("a")
        mixed = self.store.put(merged.join(mixed, "a", "left_semi"), f"mixed{k}")
        # groups that an earlier document has too, and groups of mixed anchors: where they are in the new documents
        again = run.select("a", "g", "last").join(merged.select("a", "g", F.col("first.id").alias("first")), ["a", "g"]) if len(self.runs) > 1 else run.select("a", "g", "last", F.col("first.id").alias("first"))
        again = again.where("last > first").select("a", "g", "first", F.lit(False).alias("own"))
        again = again.unionByName(mixed.where(f"batch = {k}").select("a", "g", F.col("first.id").alias("first"), F.lit(True).alias("own")))
        again = self.store.put(again.groupBy("a", "g", "first").agg(F.max("own").alias("own")), f"again{k}")
        hits = self.store.put(rows.join(again, ["a", "g"]).where("id > first or own and id = first").select("id", "t", "s", "n", (F.col("id") > F.col("first")).alias("whole")), f"hits{k}")
        whole = hits.where("whole").select("id", "t", "s", "n")
        # a first document is judged at every place where it has the group, and so is each of the rows that share its id
        need = mixed.select("first.*", (F.col("batch") == k).alias("new")).unionByName(hits.where("not whole").select("id", "t", "s", "n", F.lit(True).alias("new")))
        need = need.groupBy("id", "t").agg(F.collect_set(F.struct("s", "n")).alias("spans"), F.max("new").alias("new"))
        win = self.store.put(self._windows(history, need), f"win{k}")
        # stored, so that the join below reads both sides as they are and its hot windows can be split
        seen = self.store.put(win.groupBy("w", "c").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("w", "c", "first"), f"seen{k}")
        single = win.where("new").join(seen, ["w", "c"]).where("id > first").select("id", "t", "s", F.lit(1).alias("n"))
        out = self.store.put(whole.unionByName(single), f"repeats{k}")
        for name in (f"rows{k}", f"mixed{k}", f"again{k}", f"hits{k}", f"win{k}", f"seen{k}", *([f"merged{k}"] if len(self.runs) > 1 else [])):
            self.store.drop(name)
        if len(self.runs) > self.max_runs:
            self.compact()
        return out

    def _windows(self, docs: DataFrame, need: DataFrame) -> DataFrame:
        """id, t, s, new, w and c (hashes) of each single window in ``need``'s spans."""
        width = self.width
        docs = docs.select("doc_id", "text").where("doc_id is not null").withColumn("_t", _text_crc())
        docs = docs.join(need, (docs["doc_id"] == need["id"]) & (docs["_t"] == need["t"]))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(it):
                texts = as_bytes(batch.column("text"))
                ids, crc, new = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "t", "new"))
                spans = batch.column("spans")
                for lo, hi in cut(batch, texts, 1 << 21):
                    t = _Text(texts[lo:hi])
                    part = spans.slice(lo, hi - lo)
                    flat, many = part.flatten(), part.value_lengths().to_numpy()
                    row = np.repeat(np.arange(hi - lo), many)
                    s, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("s", "n"))
                    row, s = np.repeat(row, n), np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    at = t.start[row] + s
                    w = t.digests(at, at + width)
                    c = (t.hashes(at, at + width) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for x in range(0, len(at), 100_000):
                        y = slice(x, x + 100_000)
                        cols = [pa.array(ids[lo:hi][row[y]]), pa.array(crc[lo:hi][row[y]]), pa.array(s[y].astype(np.int32)), pa.array(new[lo:hi][row[y]].astype(bool)), _signed(w[y]), pa.array(c[y])]
                        yield pa.record_batch(cols, ["id", "t", "s", "new", "w", "c"])

        return docs.select("id", "t", "text", "spans", "new").mapInArrow(run, "id long, t long, s int, new boolean, w long, c int")


def _cleaned(docs: DataFrame, repeats: DataFrame, width: int) -> DataFrame:
    spans = repeats.groupBy("id", "t").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    docs = docs.select("doc_id", "text").withColumn("_t", _text_crc())
    docs = docs.join(spans, (docs["doc_id"] == spans["id"]) & (docs["_t"] == spans["t"]), "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            texts, total, gone, kept = as_bytes(batch.column("text")), [], [], []
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                words = text.split()
                total.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["s"] for x in spans], 1)
                    np.add.at(edge, [x["s"] + x["n"] - 1 + width for x in spans], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, x in zip(words, stay.tolist()) if x]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch(cols, ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, store: Store, width: int = WIDTH, gram: int = GRAM, parts: int = 2, max_runs: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words that no repeated window covers, joined by one space.

    The documents are ingested as ``parts`` batches in the order of their ids.
    """
    index = WindowIndex(store, width, gram, max_runs)
    ends = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    found, low = [], None
    for high in [*map(int, ends), None]:
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        found.append(index.ingest(part, docs if high is None else docs.where(F.col("doc_id") <= high)))
        low = high
    return _cleaned(docs, reduce(DataFrame.unionByName, found), width)
