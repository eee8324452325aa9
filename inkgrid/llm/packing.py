"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. The plan is made on the histogram of piece lengths alone (its
size is bounded by the capacity): the longest length left looks up the gap it leaves in an index of single, pair and
triple length sums, and the combination found is used as often as all its lengths are available. What no combination
fills exactly goes by best fit. Pieces then find their places by their gapless rank within their length.

Defined results: null text is empty and still one piece (its end token); ties in length are served in the order of
(doc_id, piece); rows that repeat an id are packed each; a null doc_id is packed like any other; an empty table gives no
piece; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, Store, as_bytes, batches, numbered, use_only, worker_cache

CAPACITY = 2048
#: Low bits of a piece's row number: its place among those of the task that made it.
PART_BITS = 36
#: Bytes of the cache of words' ids in a worker (with a third of it, tokenising took half as long again).
IDS_BYTES = 112 << 20
#: Token that ends a document.
END = b"\0\0\0\0"


#: A word that the tokenizer's normal form and splitting leave as it is (precomposed lower-case Latin letters), with a tail of ASCII
#: punctuation, which is another word to the tokenizer, whatever it is. (The apostrophe is not one of the tail, nor is what begins a special token.)
_WORD = re.compile("([a-zß-öø-ÿĀ-įĲ-ňŊ-ž]+)([!-&(-/:;=-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """A letter for each byte, as byte-level vocabularies have it: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return dict(zip([*own, *(b for b in range(256) if b not in set(own))], map(chr, [*own, *range(256, 512)])))


def _splits(path: str) -> bool:
    """Whether the vocabulary's own rules are those that words are looked up by: NFC, white space parts and goes, lower case, letters of bytes."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    form, cut = ((rules.get(k) or {}) for k in ("normalizer", "pre_tokenizer"))
    return [x.get("type") for x in form.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cut.get("pretokenizers", [])] == ["Split", "ByteLevel"] and not cut["pretokenizers"][1].get("add_prefix_space")


class _Ids(Recent):
    """Little-endian ids of what stands between two white spaces."""

    def __init__(self, path: str, budget: int = IDS_BYTES):
        super().__init__(self._ids, budget)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        found = _WORD.fullmatch(text)
        if found and found[1].islower():
            word, tail = found.groups()
            if tail:
                return self[word.encode()] + self[tail.encode()]
            # one word: its bytes' letters go to the merges directly
            letters = text if text.isascii() else chunk.decode("latin-1").translate(self.letters)
            return array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()
        low = chunk.lower() if b"<|" not in chunk else chunk  # the tokenizer does so too, but for its special tokens
        return self[low] if low != chunk else array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_IDS: dict[str, _Ids] = worker_cache({})


def word_tokens(path: str) -> Callable[[bytes], bytes]:
    """Ids of a text. Where the tokenizer drops white space, ASCII white space parts independent chunks, each looked up; else it encodes whole texts."""
    use_only(_IDS)
    if path not in _IDS:
        from tokenizers import Tokenizer

        _IDS[path] = _Ids(path) if _splits(path) else Tokenizer.from_file(path)
    held = _IDS[path]
    if not isinstance(held, _Ids):
        return lambda text: np.array(held.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    get = held.__getitem__
    return lambda text: b"".join([get(w) for w in (text if b"<|" in text else text.lower()).split()])


def id_width(path: str) -> int:
    """Bytes that hold any id of the vocabulary: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, width: int = 4) -> DataFrame:
    """row (different for each piece), doc_id, piece, start, length, ids (little-endian in ``width`` bytes, the document's end token included)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, stride = word_tokens(path), 4 * capacity
        row = TaskContext.get().partitionId() << PART_BITS
        for batch in batches(it):
            owner, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                whole = encode(text) + END
                for k, at in enumerate(range(0, len(whole), stride)):
                    part = whole[at : at + stride]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part if width == 4 else np.frombuffer(part, "<u4").astype("<u2").tobytes())
            keys = batch.column("doc_id").cast(pa.int64()).take(pa.array(owner, pa.int64()))
            for lo in range(0, len(owner), 5000):
                y = slice(lo, lo + 5000)
                cols = [pa.array(np.arange(row, row + len(piece[y]))), keys.slice(lo, 5000), pa.array(piece[y], pa.int32()), pa.array(start[y], pa.int64()), pa.array(length[y], pa.int64()), pa.array(ids[y], pa.binary())]
                row += len(piece[y])
                yield pa.record_batch(cols, ["row", "doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids binary")


class Sums:
    """What single lengths, pairs and triples of them sum up to, built once for all gaps up to the capacity.

    ``pair[s, x]``: x and s - x are lengths, x the smaller one. ``triple[s, x]``: x is a length and s - x is a pair of
    lengths of x at least. Lengths that are used up stay in the index; whoever uses it looks at what is left.
    """

    def __init__(self, lengths: list[int], capacity: int):
        here = np.zeros(capacity + 1, bool)
        here[lengths] = True
        s, x = np.arange(capacity + 1)[:, None], np.arange(capacity + 1)[None, :]
        rest = np.maximum(s - x, 0)
        self.single = here
        self.pair = here[None, :] & here[rest] & (x <= s - x)
        self.largest = np.where(self.pair.any(1), capacity - np.argmax(self.pair[:, ::-1], axis=1), -1)  # smaller member of the most even pair
        self.triple = here[None, :] & (self.largest[rest] >= x) & (x < s)

    def fill(self, gap: int, left: dict[int, int]) -> Iterator[tuple[int, ...]]:
        """Combinations of lengths still left that are exactly ``gap``: single, pairs, triples, the most even ones first."""
        if self.single[gap] and gap in left:
            yield (gap,)
        for x in np.nonzero(self.pair[gap])[0][::-1].tolist():
            if x in left and gap - x in left:
                yield (gap - x, x)
        for x in np.nonzero(self.triple[gap])[0][::-1].tolist():
            if x in left:
                pairs = np.nonzero(self.pair[gap - x, x:])[0][::-1] + x
                yield from ((gap - x - y, y, x) for y in pairs.tolist() if y in left and gap - x - y in left)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just these) until the histogram is used up."""
    left = {k: v for k, v in histogram.items() if v}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a length is outside 1 to the capacity")
    out: list[tuple[tuple[int, ...], int]] = []
    order = sorted(left)
    sums = Sums(order, capacity)

    def spend(lengths: tuple[int, ...]) -> int:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(left.get(x, 0) // n for x, n in need.items())
        if times:
            out.append((lengths, times))
            for x, n in need.items():
                left[x] -= times * n
                if not left[x]:
                    del left[x]
                    order.remove(x)
        return times

    # the longest first: its complement is the hardest to find; lengths no combination completes are set aside
    aside: dict[int, int] = {}
    while order:
        top = order[-1]
        if top == capacity:
            spend((top,))
            continue
        found = False
        for combo in sums.fill(capacity - top, left):
            while left.get(top) and spend((top, *combo)):
                found = True
            if top not in left:
                break
        if top in left:
            aside[top] = left.pop(top)
            order.remove(top)
        if not found and not order:
            break
    out.extend(_best_fit(aside, capacity))
    return out


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on equal open sequences at once: each goes where it leaves the smallest gap."""
    gaps: list[int] = []  # of open sequences, sorted
    by_gap: dict[int, list[list]] = {}  # gap: [lengths, how many]

    def add(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append([lengths, times])

    for x in sorted(rest, reverse=True):
        n = rest[x]
        while n:
            k = bisect_right(gaps, x - 1)
            if k < len(gaps):
                gap = gaps[k]
                lengths, times = by_gap[gap][-1]
                # as many pieces into each of these sequences as fit
                each = min(gap // x, n)
                used = min(times, n // each)
                by_gap[gap][-1][1] -= used
                if not by_gap[gap][-1][1]:
                    by_gap[gap].pop()
                    if not by_gap[gap]:
                        del by_gap[gap]
                        gaps.remove(gap)
                add((*lengths, *[x] * each), used)
                n -= used * each
            else:
                each = min(capacity // x, n)
                used = n // each
                add(tuple([x] * each), used)
                n -= used * each
    return [(lengths, times) for group in by_gap.values() for lengths, times in group]


def _places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, pieces of this length in a sequence, first sequence, offset of the first one."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in made:
        offset, i, ordered = 0, 0, sorted(lengths, reverse=True)
        while i < len(ordered):
            x, k = ordered[i], ordered.count(ordered[i])
            rows.setdefault(x, []).append((used.get(x, 0), k, sequence, offset))
            used[x] = used.get(x, 0) + k * times
            offset += k * x
            i += k
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def packed(docs: DataFrame, store: Store, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    if with_ids:
        found = store.put(pieces(docs, path, capacity).drop("row"), "pieces")
        found = found.withColumn("ids_crc32", F.crc32("ids"))
    else:
        found = store.put(pieces(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids", "row"), "pieces")
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # one row for each length up to the capacity
    ranked = numbered(found, "_rank", ["doc_id", "piece", "start", "ids_crc32"], ["length"], rows=sum(counts.values()))
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))  # bounded by the capacity, not by the rows
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long{', ids binary' * with_ids}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                here = np.nonzero(length == x)[0]
                first, each, start, at = places.value[x]
                k = np.searchsorted(first, rank[here], "right") - 1
                past = rank[here] - first[k]
                sequence[here] = start[k] + past // each[k]
                offset[here] = at[k] + past % each[k] * x
            cols = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(cols + ([batch.column("ids")] if with_ids else []), [x.split()[0] for x in schema.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank", *["ids"] * with_ids).mapInArrow(run, schema)


def crc32(ids: list[int]) -> int:
    """Of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
