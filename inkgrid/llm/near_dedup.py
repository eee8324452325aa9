"""SimHash near-deduplication with a pigeonring filter.

A text becomes a 64-bit fingerprint: each bit is the majority of that bit over the XXH64 hashes of its word
shingles. Two fingerprints at most ``tau`` bits apart, cut into ``m`` segments on a ring, have a start from which
every chain of l consecutive segments differs in at most l*tau/m bits. With two segments more than ``tau`` at least two
are equal: candidates meet in blocks that agree on two segments, chains from one of these prune them, and the full
distance decides.

For near copies by shingle overlap (``similar_documents``) documents meet first where their fingerprints are linked. To
reach all pairs of that overlap 64 bits would need a tolerance at which a single segment selects nothing, so those that
are not joined yet meet by minima of their shingle hashes: by single minima, then by bands of three. In a block, one document after another is held against those
not joined with it yet: parities of shingle counts prune by a bound that no pair within
reach can break, and the exact Jaccard similarity of the shingle sets decides.

Blocks above ``cap`` rows are split into tiles, each pair of tiles a task's work: no row or pair is lost. A block
returns a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; texts with fewer words than a shingle are one shingle; without words
the fingerprint is zero (linked like any other). Rows with a null doc_id get a fingerprint but take part in no
link. Rows that repeat an id share its component. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, as_bytes, batches, use_only
from .components import components

#: Rows compared with each other at once.
BLOCK = 4000
_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)
#: Factors of the shingle hashes whose minima are keys: the first SINGLES alone, then BANDS of WIDE together.
SINGLES, BANDS, WIDE = 4, 24, 3
_MINIMA = np.array([xxhash.xxh64_intdigest(b"%d" % i, 7) | 1 for i in range(SINGLES + BANDS * WIDE)], np.uint64)
#: Bits of the parities.
PARITIES = 1024
#: Bytes of a long text, and hashes, that are worked on at once.
PART, HASHES = 1 << 22, 1 << 16
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the text with A-Z lowered, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    s, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return np.array([digest(s[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def shingle_parts(text: bytes, k: int, part: int = PART) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of a text of any length, some ``part`` bytes of words at a time."""
    if len(text) <= part:
        yield shingle_hashes(text, k)
        return
    at, held, some = 0, b"", False  # held: what has been read but for shingles that are whole
    while at < len(text):
        cut = _SPACE.search(text, at + part)
        end = cut.start() if cut else len(text)
        held += b" " + text[at:end]
        at = end
        tail = held.rsplit(maxsplit=k)
        if len(tail) > k or len(tail) == k and not tail[0][:1].isspace():
            found = shingle_hashes(held, k)
            yield found
            some = True
            held = b" ".join(held.rsplit(maxsplit=k - 1)[1 - k :] if k > 1 else [])
    if not some:
        yield shingle_hashes(held, k)


def simhash(h: np.ndarray) -> int:
    """Majority bits of the hashes; 0 if there are none."""
    return majority([h])


def majority(parts: Iterable[np.ndarray]) -> int:
    """The same for hashes that come part by part."""
    sums, n = np.zeros(64, np.int64), 0
    for h in (h[lo : lo + HASHES] for h in parts for lo in range(0, len(h), HASHES)):
        # each hash byte becomes eight byte-wide counters, summed 255 rows at a time so that none overflows
        counters = _SPREAD[h.view(np.uint8).reshape(len(h), 8)]
        sums += np.add.reduceat(counters, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(sums * 2 > n, bitorder="little").view("<u8")[0])


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(m: int, start: int, length: int) -> np.uint64:
    return np.uint64(sum(((1 << w) - 1) << s for s, w in (segments(m)[(start + i) % m] for i in range(length))))


def ring_pairs(a: np.ndarray, b: np.ndarray, tau: int, m: int, start: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with a[i] and b[j] at most tau bits apart whose chains from ``start`` (None: from any) stay in budget."""
    left, right, step = [], [], max(1, 2_000_000 // max(1, len(b)))
    for lo in range(0, len(a), step):
        x = a[lo : lo + step, None] ^ b[None, :]
        if start is None:
            i, j = np.nonzero(np.bitwise_count(x) <= tau)
            x = x[i, j]
            ok = np.zeros(len(x), bool)
            for s in range(m):
                rest = np.ones(len(x), bool)
                for n in range(1, m + 1):
                    rest &= np.bitwise_count(x & _mask(m, s, n)) <= n * tau // m
                ok |= rest
            i, j = i[ok], j[ok]
        else:
            i, j = np.nonzero(np.bitwise_count(x & _mask(m, start, 2)) <= 2 * tau // m)
            x = x[i, j]
            for n in range(3, m + 1):
                ok = np.bitwise_count(x & _mask(m, start, n)) <= n * tau // m
                i, j, x = i[ok], j[ok], x[ok]
            ok = np.bitwise_count(x) <= tau
            i, j = i[ok], j[ok]
        left.append(i + lo)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the links (i, j)."""
    label = np.arange(n)
    while len(i):
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (old == label).all():
            break
    node = np.nonzero(label != np.arange(n))[0]
    return node, label[node]


def tiled(rows: DataFrame, keys: list[str], tie: Column, cap: int = BLOCK) -> DataFrame:
    """Rows with (p, q, tile): a key above ``cap`` rows is split so that each pair of tiles meets in one block."""
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    hot = hot.select(*keys, F.ceil(F.col("_n") / cap).cast("int").alias("_t"))
    rows = rows.join(hot, keys, "left").withColumn("_t", F.coalesce("_t", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(tie), F.col("_t")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda x: F.struct(F.least("tile", x).alias("p"), F.greatest("tile", x).alias("q")))
    return rows.withColumn("_pq", F.explode(pairs)).select("*", "_pq.p", "_pq.q").drop("_pq", "_t")


def blocks(rows: DataFrame, keys: list[str], link: Callable[[pa.Table, tuple], tuple[np.ndarray, ...]], counted: bool = False) -> DataFrame:
    """Run ``link`` on each block of ``tiled`` rows; links (a, b), with ``counted`` also a column that marks counts."""
    names = ["a", "b", "counted"][: 2 + counted]
    by = [*keys, "p", "q"]
    dealt = rows.repartition(*by).sortWithinPartitions(*by)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            if t.num_rows > 1:
                found = link(t, at)
                if len(found[0]):
                    yield pa.record_batch([pa.array(x) for x in found], names)

        for batch in batches(it):
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.nonzero(new)[0], [batch.num_rows]])
            some = np.diff(cuts) > 1  # a row alone links with nothing; the first and the last block may go on
            some[[0, -1]] = True
            for lo, hi in zip(cuts[:-1][some].tolist(), cuts[1:][some].tolist()):
                key = tuple(c[lo] for c in cols)
                if at is not None and key != at and held:
                    yield from close()
                at = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close()

    return dealt.mapInArrow(run, ", ".join(f"{x} {'boolean' if x == 'counted' else 'long'}" for x in names))


def _sides(t: pa.Table, at: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers to compare: all with all in a tile of its own, else one tile with the other."""
    tile = t.column("tile").to_numpy()
    if at[-2] == at[-1]:
        every = np.arange(t.num_rows)
        return every, every
    return np.nonzero(tile == at[-2])[0], np.nonzero(tile == at[-1])[0]


def _links(t: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    node, root = forest(t.num_rows, i, j)
    return ids[node], ids[root]


def fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(it):
        for batch in batches(it):
            fps = np.array([majority(shingle_parts(t, k)) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, tau: int = 4, m: int | None = None, cap: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all ids of ``fps(id, fp)`` whose fingerprints are at most tau bits apart. fp must be unique.

    With m > tau segments, m - tau of them are equal in such a pair. Where that is two or more, blocks are keyed by two
    equal segments, each pair of segments for itself: as many as tau + 2 segments of 64 bits make keys of 21 bits.
    """
    m = m or tau + 2
    if m <= tau:
        raise ValueError("with m > tau segments, one of them is equal")
    chosen = [(i, j) for i in range(m) for j in range(i + 1, m)] if m > tau + 1 else [(i,) for i in range(m)]
    part = lambda i: F.shiftrightunsigned("fp", segments(m)[i][0]).bitwiseAND(F.lit((1 << segments(m)[i][1]) - 1))
    value = lambda c: part(c[0]) if len(c) == 1 else F.shiftleft(part(c[0]), segments(m)[c[1]][1]).bitwiseOR(part(c[1]))
    keys = [F.struct(F.lit(k).alias("seg"), value(c).alias("val")) for k, c in enumerate(chosen)]
    rows = fps.where("id is not null").select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", "k.seg", "k.val")

    def link(t: pa.Table, at: tuple):
        fp = t.column("fp").to_numpy().view(np.uint64)
        left, right = _sides(t, at)
        # a chain that stays in budget begins with an equal segment: in some block that is one of the block's own
        found = [ring_pairs(fp[left], fp[right], tau, m, start) for start in chosen[int(at[0])]]
        i, j = (np.concatenate(x) for x in zip(*found))
        i, j = left[i], right[j]
        return _links(t, i[i != j], j[i != j])

    return blocks(tiled(rows, ["seg", "val"], F.col("id"), cap), ["seg", "val"], link)


def simhash_groups(docs: DataFrame, store: Store, k: int = 5, tau: int = 4, m: int | None = None, cap: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included)."""
    fps = store.put(fingerprints(docs, k), "fps")
    one = store.put(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    comp = components(fingerprint_links(one, tau, m, cap), store)
    named = one.join(comp, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _minima(h: np.ndarray) -> np.ndarray:
    """The least product of the hashes with each factor."""
    out = np.full(len(_MINIMA), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 2000):
        np.minimum(out, (h[lo : lo + 2000, None] * _MINIMA).min(0), out)
    return out


def _distinct(text: bytes, k: int) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_parts(text, k)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """row (a number of its own), id, t (hash of the text), n (different shingles), fp (the fingerprint), single and bands (keys of the minima)."""

    def run(it):
        from pyspark import TaskContext

        use_only(None)
        row = TaskContext.get().partitionId() << 36
        for batch in batches(it):
            sizes, fps, single, bands = [], [], [], []
            for text in as_bytes(batch.column("text")):
                parts = list(shingle_parts(text, k))
                fps.append(majority(parts))
                h = np.unique(np.concatenate(parts))
                sizes.append(len(np.unique(h.astype(np.uint32))))
                # texts without words meet by a key of their own
                least = _minima(h) if len(h) else np.zeros(len(_MINIMA), np.uint64)
                single.append(least[:SINGLES].view(np.int64))
                wide = least[SINGLES:].reshape(BANDS, WIDE)
                mixed = wide[:, 0].copy()
                for i in range(1, WIDE):
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + wide[:, i]
                bands.append((mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            ends = np.arange(len(sizes) + 1, dtype=np.int32)
            cols = [pa.array(np.arange(row, row + len(sizes))), batch.column("doc_id").cast(pa.int64()), batch.column("t"), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            cols += [pa.ListArray.from_arrays(pa.array(ends * x), pa.array(np.concatenate(keys))) for x, keys in ((SINGLES, single), (BANDS, bands))]
            row += len(sizes)
            yield pa.record_batch(cols, ["row", "id", "t", "n", "fp", "single", "bands"])

    docs = docs.where("doc_id is not null").select("doc_id", "text", _text_hash().alias("t"))
    return docs.mapInArrow(run, "row long, id long, t long, n int, fp long, single array<long>, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """id, shingles (the set of 32-bit shingle hashes) of ``docs(row, text)``."""

    def run(it):
        use_only(None)
        for batch in batches(it):
            sets = [np.unique(_distinct(t, k).astype(np.uint32)).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("row"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.select("row", "text").mapInArrow(run, "id long, shingles binary")


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, as bits, whether odd numbers of its elements fall into each of PARITIES classes.

    Two sets differ in at least as many elements as their parities in bits.
    """
    flat = np.concatenate(sets).astype(np.int64) % PARITIES if sets else np.empty(0, np.int64)
    cells = np.bincount(np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * PARITIES + flat, minlength=len(sets) * PARITIES)
    return np.packbits((cells & 1).astype(bool).reshape(len(sets), PARITIES), axis=1).view(np.uint64)


def within(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the rows b may be as similar to the one row a as that, by parities and sizes (n of a, m of b).

    A pair of that similarity differs in at most (1 - similarity) / (1 + similarity) of both sizes together.
    """
    j = np.nonzero(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)[0]
    most = (n + m[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return j[np.bitwise_count(a ^ b[j]).sum(1, dtype=np.int64) <= most]


def join_similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between left and right (the same rows, or two tiles) that join what all pairs of that Jaccard similarity would join.

    A row is compared only with rows that are not joined with it yet, so a group of near copies takes about as many
    comparisons as it has rows.
    """
    label, n = np.arange(len(sets)), np.array([len(x) for x in sets], np.float64)
    marks, found = parities(sets), []
    same = left is right
    for at, i in enumerate(left.tolist()):
        others = right[at + 1 :] if same else right
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        others = others[within(marks[i], marks[others], n[i], n[others], similarity)]
        if not len(others):
            continue
        own, each = sets[i], [sets[j] for j in others.tolist()]
        if len(own):
            flat = np.concatenate(each)
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            starts = np.cumsum([0, *(len(x) for x in each[:-1])])
            both = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
            others = others[both >= similarity * (n[i] + n[others] - both) - 1e-9]
        # without words both sets are empty and the texts are equal
        for j in others.tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    if not found:
        return (np.empty(0, np.int64),) * 2
    a, b = np.array(found).T
    return a, b


def _key_links(docs: DataFrame, store: Store, keyed: DataFrame, k: int, similarity: float, cap: int, name: str) -> DataFrame:
    """Links between rows of ``keyed(id, key, doc, t, n)`` that have a key in common and are as similar as that."""
    rows = store.put(keyed.dropDuplicates(["id", "key"]), name)
    need = rows.select(F.col("id").alias("row"), F.col("doc").alias("_d"), F.col("t").alias("_t")).distinct()
    texts = docs.where("doc_id is not null").select("doc_id", "text").withColumn("_h", _text_hash())
    texts = texts.join(need, (texts["doc_id"] == need["_d"]) & (texts["_h"] == need["_t"]))
    rows = rows.select("id", "key", "n").join(_sets(texts, k).dropDuplicates(["id"]), "id")

    def link(t: pa.Table, at: tuple):
        left, right = _sides(t, at)
        i, j = join_similar([np.frombuffer(x, np.uint32) for x in t.column("shingles").to_pylist()], left, right, similarity)
        return _links(t, i, j)

    return blocks(tiled(rows, ["key"], F.col("id"), cap), ["key"], link)


def fingerprint_keys(sketch: DataFrame, store: Store, tau: int = 4) -> DataFrame:
    """Rows of ``sketch`` that are linked with another at ``tau`` differing bits of their fingerprints, with a key for each such group."""
    one = store.put(sketch.groupBy("fp").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("c")), "fingerprints")
    groups = one.join(components(fingerprint_links(one.select("id", "fp"), tau), store, "cc0"), "id", "left").where("c > 1 or component is not null")
    return sketch.join(groups.select("fp", F.coalesce("component", "id").alias("key")), "fp")


def similar_links(docs: DataFrame, sketch: DataFrame, store: Store, k: int = 5, similarity: float = 0.8, cap: int = 1500, tau: int = 4) -> DataFrame:
    """Links (a, b) that join rows of ``sketch`` whose sets of k-word shingles have a Jaccard similarity of ``similarity`` or more.

    Rows meet first where their SimHash fingerprints are linked at ``tau`` bits (``fingerprint_links``), then by minima
    where these left them apart; the similarity decides each time. Two such rows share none of the bands of minima with probability (1 - similarity^WIDE)^BANDS at most (3.3e-8 at
    0.8). Rows joined by single minima before need not meet again in a band.
    """
    row = [F.col("row").alias("id"), F.col("id").alias("doc"), "t", "n"]
    found = store.put(_key_links(docs, store, fingerprint_keys(sketch, store, tau).select(*row, "key"), k, similarity, cap, "alike"), "links0")
    for i, (keys, name) in enumerate((("single", "singles"), ("bands", "bands")), 1):
        named = components(found, store, f"cc{i}").withColumnRenamed("id", "_i")
        keyed = sketch.select(*row, F.col(keys).alias("_k")).join(named, F.col("id") == F.col("_i"), "left")
        keyed = store.put(keyed.select("id", "doc", "t", "n", F.coalesce("component", "id").alias("component"), F.explode(F.array_distinct("_k")).alias("key")), name)
        apart = keyed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
        more = _key_links(docs, store, keyed.join(apart, "key", "left_semi").drop("component"), k, similarity, cap, f"apart{i}")
        found = store.put(found.unionByName(more), f"links{i}")
    return found


def similar_documents(docs: DataFrame, store: Store, k: int = 5, similarity: float = 0.8, cap: int = 1500, tau: int = 4) -> DataFrame:
    """``docs`` with all its columns, without rows that are near copies of one with a smaller doc_id (directly or by links)."""
    sketch = store.put(_sketches(docs, k), "sketch")
    comp = components(similar_links(docs, sketch, store, k, similarity, cap, tau), store)
    named = store.put(comp.join(sketch.select(F.col("row").alias("id"), F.col("id").alias("doc"), "t"), "id").select("component", "doc", "t"), "named")
    least = store.put(named.groupBy("component").agg(F.min("doc").alias("least")), "least")
    gone = named.join(least, "component").where("doc > least").select(F.col("doc").alias("_gone"), F.col("t").alias("_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_text"]), "left_anti")
