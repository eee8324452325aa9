"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is taken as a stream
of lower-cased letters, everything between letter runs being one space, and parsed into phrases, each the longest match
with the automaton, across words; the language that needs the fewest phrases per symbol wins. When languages need
equally many, the shorter code wins: a phrase costs the logarithm of the sample's length over the phrase's number of
occurrences there.

Automata are packed into arrays (a state's transitions lie at its base plus the letter), so that a step is taken for
many texts and all languages at once. For that, streams are cut into segments of ``SEGMENT`` symbols; a phrase ends
where its segment does, in every language alike. Every text is parsed whole.

Fitted on a bounded sample: of each label the texts of labelled documents in the order of a hash, cut where there are
``SAMPLE_CHARS`` symbols (fewer when there are over 100 labels: ``ALL_CHARS`` in all); of the labels, the
``MOST_LABELS`` that most documents have (others are taken for junk and not predicted).

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled text everything is
``und``; ties between languages go to the first in order of name; rows with a null or repeated id are predicted like
any other; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, cut, use_only, worker_cache

#: Symbols that a language is learned from, symbols of all languages, labels that are learned, documents of a label that are looked at for them (about so many).
SAMPLE_CHARS, ALL_CHARS, MOST_LABELS, SAMPLE_DOCS = 40_000, 4_000_000, 256, 400
#: Symbols that are parsed in one go, bytes of text at a time.
SEGMENT, PIECE = 256, 1 << 20
#: Phrases per symbol of the best language above which a text is in none of them: phrases of under two letters.
FOREIGN = 0.5
#: Free places that are tried for a state.
TRIES = 30
_LETTERS: list[np.ndarray] = []


def _symbols(text: bytes) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one space, with a space at both ends."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    code = np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[0][code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, code, np.uint32(32))[keep]


class Automaton:
    """Suffix automaton: for each state its transitions and how often its substrings occur."""

    def __init__(self, text: str):
        links, sizes, moves, times, last = [-1], [0], [{}], [0], 0
        for ch in text:
            now = len(links)
            links.append(0)
            sizes.append(sizes[last] + 1)
            moves.append({})
            times.append(1)
            p = last
            while p != -1 and ch not in moves[p]:
                moves[p][ch] = now
                p = links[p]
            if p != -1:
                q = moves[p][ch]
                if sizes[q] == sizes[p] + 1:
                    links[now] = q
                else:
                    twin = len(links)
                    links.append(links[q])
                    sizes.append(sizes[p] + 1)
                    moves.append(dict(moves[q]))
                    times.append(0)
                    while p != -1 and moves[p].get(ch) == q:
                        moves[p][ch] = twin
                        p = links[p]
                    links[q] = links[now] = twin
            last = now
        for s in sorted(range(1, len(sizes)), key=sizes.__getitem__, reverse=True):
            if links[s] > 0:
                times[links[s]] += times[s]
        self.moves, self.times, self.size = moves, times, len(text)
        self.price = [math.log2((len(text) + 1) / (t + 0.5)) for t in times]


@dataclass
class Packed:
    """An automaton in arrays: the transition of state s by letter c, if it has one, is at base[s] + c, where owner is s."""

    letters: np.ndarray  # code points, ascending; letter 0 is none of them
    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    price: np.ndarray


def pack(text: str) -> Packed:
    a = Automaton(text)
    letters = sorted(set(text))
    number = {c: i + 1 for i, c in enumerate(letters)}
    width = len(letters) + 1
    base = np.zeros(len(a.moves), np.int32)
    taken = bytearray(4 * len(a.moves) + 2 * width)
    cursor, end = 0, 0  # where free cells are looked for, and beyond all cells taken
    # states with several transitions first, each at one of the next free places that take all of them, or behind all others
    for s in sorted(range(len(a.moves)), key=lambda s: -len(a.moves[s])):
        here = sorted(number[c] for c in a.moves[s])
        if len(here) == 1 and cursor is not None:
            cursor, single = None, 0
        if cursor is None:
            if here:  # a single transition goes anywhere
                single = at = taken.index(0, max(single, here[0]))
                base[s] = at - here[0]
                taken[at] = 1
            continue
        at = cursor
        for _ in range(TRIES):
            at = taken.index(0, max(at, here[0]))
            if not any(taken[at - here[0] + c] for c in here):
                break
            at += 1
        else:
            cursor = at = max(cursor, end - width)
            while any(taken[max(0, at - here[0]) + c] for c in here):
                at += 1
            at = max(at, here[0])
        base[s] = at - here[0]
        for c in here:
            taken[base[s] + c] = 1
        end = max(end, int(base[s]) + here[-1] + 1)
    size = int(base.max()) + width
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for s, moves in enumerate(a.moves):
        for c, t in moves.items():
            owner[base[s] + number[c]], to[base[s] + number[c]] = s, t
    return Packed(np.array([ord(c) for c in letters], np.uint32), base, owner, to, np.array(a.price, np.float32))


class Model:
    """Packed automata of all languages, one behind the other."""

    def __init__(self, packed: dict[str, Packed]):
        self.langs = sorted(packed)
        every = [packed[k] for k in self.langs]
        self.letters = np.unique(np.concatenate([p.letters for p in every])) if every else np.empty(0, np.uint32)
        self.number = np.zeros(int(self.letters[-1]) + 2 if len(self.letters) else 1, np.int32)  # of a code point, over all languages; 0: in none
        self.number[self.letters.astype(np.int64)] = np.arange(1, len(self.letters) + 1)
        n, self.width = len(every), len(self.letters) + 1
        states, cells = (np.cumsum([0, *(len(x) for x in xs)]) for xs in ([p.base for p in every], [p.owner for p in every]))
        self.root = states[:-1].astype(np.intp)
        #: A language's own number of each letter (one far beyond its cells if it has none), and where the root goes by it, both by language and letter.
        own, start = np.full((n, self.width), -1, np.int32), np.repeat(self.root[:, None], self.width, axis=1)
        for k, p in enumerate(every):
            at = np.searchsorted(self.letters, p.letters) + 1
            own[k, at] = np.arange(1, len(p.letters) + 1)
            cell = p.base[0] + own[k, at]
            start[k, at] = np.where(p.owner[cell] == 0, p.to[cell], 0) + states[k]
        self.own, self.start = own.ravel(), start.ravel()
        join = lambda xs, kind: np.concatenate([*xs, np.empty(0, kind)]).astype(kind)
        # cell 0 belongs to no state: letters that a language doesn't have lead there
        self.base = join([p.base + c + 1 for p, c in zip(every, cells)], np.int32)
        self.owner = join([[-1], *(np.where(p.owner < 0, -1, p.owner + s) for p, s in zip(every, states))], np.int32)
        self.to = join([[0], *(p.to + s for p, s in zip(every, states))], np.int32)
        self.price = join([p.price for p in every], np.float32)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: symbols (0 without letters), then phrases and cost for each language."""
        streams = [_symbols(t) for t in texts]
        sizes = np.array([len(s) if len(s) > 1 else 0 for s in streams])
        n, m = len(texts), len(self.langs)
        phrases, cost = np.zeros((n, m)), np.zeros((n, m))
        if not m or not sizes.any():
            return sizes, phrases, cost
        flat = np.concatenate([s for s, k in zip(streams, sizes.tolist()) if k])
        flat = self.number[np.minimum(flat, len(self.number) - 1)]
        # segments, the long ones first: those still going on are the first rows
        many = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(n), many)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
        length = np.minimum(SEGMENT, sizes[text] - at)
        start = np.repeat(np.cumsum(sizes) - sizes, many) + at
        order = np.argsort(-length, kind="stable")
        text, length, start = text[order], length[order], start[order]
        # one row for each language, then all in one line
        rows = len(text)
        lines = np.arange(m, dtype=np.int32)[:, None] * np.int32(self.width)
        state = np.repeat(self.root[:, None], rows, axis=1)
        found, paid = np.zeros((m, rows), np.int32), np.zeros((m, rows), np.float32)
        root_price = self.price[self.root]
        for t in range(int(length[0])):
            while length[rows - 1] <= t:
                rows -= 1
            at = flat[start[:rows] + t] + lines
            now, own = state[:, :rows], self.own.take(at)
            cell = self.base.take(now)
            cell += own
            cell *= own > 0
            ok = self.owner.take(cell) == now
            to = self.to.take(cell)
            end = np.flatnonzero(~ok)
            if len(end):
                # the phrase ends (if there is one), the next begins at the root
                k = end // rows
                root, was, begun = self.root[k], now.ravel()[end], self.start.take(at.ravel()[end])
                some, unknown = was != root, begun == root
                to.ravel()[end] = begun
                # a character the language doesn't have is a phrase of its own
                found[:, :rows].flat[end] += some.astype(np.int32) + unknown
                paid[:, :rows].flat[end] += self.price.take(was) * some + root_price[k] * unknown
            state[:, :rows] = to
        open_ = state != self.root[:, None]
        found = (found + open_).T
        paid = (paid + self.price.take(state) * open_).T
        by = np.argsort(text, kind="stable")
        first = np.searchsorted(text[by], np.nonzero(many)[0])
        phrases[many > 0] = np.add.reduceat(found[by], first)
        cost[many > 0] = np.add.reduceat(paid[by].astype(np.float64), first)
        return sizes, phrases, cost

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and phrases per symbol in that language (0 where there is none)."""
        n = len(self.langs)
        size, phrases, cost = self.score(texts)
        if not n:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        each = np.maximum(size, 1)[:, None]
        phrases, cost = phrases / each, cost / each
        best = np.lexsort((np.broadcast_to(np.arange(n), phrases.shape), cost, phrases), axis=1)[:, 0]
        every = np.arange(len(texts))
        # share of the winner when each language weighs 2^-(its cost beyond the least)
        odds = 2.0 ** -np.minimum(50, (cost - cost.min(1, keepdims=True)) * np.minimum(each, 1000))
        score = odds[every, best] / odds.sum(1)
        none = size == 0
        return ["und" if x else self.langs[b] for x, b in zip(none, best)], np.where(none, 0.0, score), phrases[every, best]


def held_out(remainder: int = 2, parts: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == remainder, F.lit(False))


def fit(docs: DataFrame, chars: int = SAMPLE_CHARS, most_docs: int = SAMPLE_DOCS, labels: int = MOST_LABELS) -> dict[str, Packed]:
    """A packed automaton for each of the ``labels`` most frequent labels, over ``chars`` symbols of its documents with the smallest hashes.

    Which hashes are small enough follows from how many documents a label has, so no label's rows meet in one task;
    what is gathered is bounded by the parameters.
    """
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").alias("_l"), "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_h"))
    counts = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_l").limit(labels).collect()
    if not counts:
        return {}
    chars = min(chars, ALL_CHARS // len(counts))
    limits = [(r._l, -(1 << 63) + min((1 << 64) - 1, (most_docs << 64) // r.n)) for r in counts]
    small = spark.createDataFrame(limits, "_l string, _most long")
    found = rows.join(F.broadcast(small), "_l").where("_h <= _most")  # at most ``labels`` rows are broadcast
    # texts reach one task a label, cut to the sample's size: about ``most_docs`` of them
    found = found.select("_l", "_h", F.substring("text", 1, 2 * chars).alias("text")).repartition("_l").sortWithinPartitions("_l", "_h", "text")

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, parts, size = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            text = " ".join(parts)[:chars]
            if text.strip():
                p = pack(f" {text.strip()} ")
                cols = [pa.array([lang]), *(pa.array([x.tobytes()], pa.binary()) for x in (p.letters, p.base, p.owner, p.to, p.price))]
                yield pa.record_batch(cols, ["lang", *_PARTS])

        for batch in batches(it):
            for label, text in zip(batch.column("_l").to_pylist(), as_bytes(batch.column("text"))):
                if label != lang:
                    if lang is not None:
                        yield from close()
                    lang, parts, size = label, [], 0
                if size < chars:
                    parts.append("".join(map(chr, _symbols(text).tolist())).strip())
                    size += len(parts[-1]) + 1
        if lang is not None:
            yield from close()

    kinds = dict(zip(_PARTS, (np.uint32, np.int32, np.int32, np.int32, np.float32)))
    learned = found.mapInArrow(learn, "lang string, " + ", ".join(f"{x} binary" for x in _PARTS)).collect()
    return {r.lang: Packed(*(np.frombuffer(bytes(r[x]), kind) for x, kind in kinds.items())) for r in learned}


_PARTS = ["letters", "base", "owner", "to", "price"]
_MODELS: dict[int, Model] = worker_cache({})


def identify(docs: DataFrame, languages: dict[str, Packed], keep: list[str] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns ``keep`` of ``docs``), lang_pred, score and rate (phrases per symbol in that language); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # bounded by fit()
    number = shared._jbroadcast.id()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), *(["text"] if "text" not in keep else []))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("rate")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(_MODELS)
        if number not in _MODELS:
            _MODELS.clear()
            _MODELS[number] = Model(shared.value)
        model = _MODELS[number]
        for batch in batches(it):
            texts = as_bytes(batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text"))
            for lo, hi in cut(batch, texts, PIECE):
                lang, score, rate = model.predict(texts[lo:hi])
                yield pa.record_batch([batch.column("row").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["row", "lang_pred", "score", "rate"])

    return rows.mapInArrow(run, schema)


def language_groups(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from labelled documents that are not held out."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, fit(docs.where("not held_out")), ["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


def accepted(docs: DataFrame, foreign: float = FOREIGN) -> DataFrame:
    """``docs`` without the documents that are in no language: those without a letter, and those that even the best language takes over ``foreign`` phrases per symbol for.

    Where no language can be learned, only documents without a letter go.
    """
    languages = fit(docs.where(~held_out()))
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, languages, docs.columns).where((F.col("lang_pred") != "und") & (F.col("rate") <= foreign)).select("row.*")
