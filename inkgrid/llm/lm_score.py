"""Language-model scores by online logistic context mixing.

A text is coded as binary decisions. Its tokens (lower-cased words and one end) follow a Huffman tree of the most
frequent training tokens (met twice at least); other words take the tree's escape and are spelled along a Huffman tree of bytes. Each
decision is predicted from three contexts by counts in hashed tables: a token decision from the node alone, the last
two frequent tokens (which tell the language) and the token before; a byte decision from the two, three and five bytes
before it in the word. The predictions are stretched (log odds), combined by a weight set that is gated by how often
each context was seen, and squashed. Weights start from a fit on training texts and words whose decisions were kept out
of the counts while they were fitted; along each text they follow the gradient of all tokens (or spelled letters) after
every 16, beyond the 512th after every 64 and beyond the 4096th after every 256.

Before a token's decisions comes one more: whether it is the token that followed the same three tokens everywhere in
the other training documents, if these agree. What follows three tokens is not kept in a table of a fixed size: all
such contexts are dealt to owners by their hash, with what each token costs otherwise, and the owners return what
every document gains. A document's own text is no evidence there, so one that occurs twice stands out. How often each
kind of agreement is right is counted by the owner, again for training documents without their own text. Contexts
that hold over 2^17 training tokens (in larger corpora over one in 2^16 of all) have no owner: all tasks sum up what follows them (how many tokens,
the two least and the two greatest of the documents), which is enough to leave any one document out.

``score`` is the code length of all decisions in log10, the spelling included, and ``bits_per_byte`` the same code
length by the text's size. The base takes all words that were never seen as one kind; ``unseen_score`` is what their
spelling costs, so ``score - unseen_score`` is on the base's footing.

Counts come from all training documents (of the spelling, from all different words): every task
counts into tables, tasks' tables are summed chunk by chunk. The tables grow with the training tokens, from 2^20 up to
2^22 entries for each context (what a worker can hold). Vocabulary counts and long contexts stay distributed, whatever
their number; only the bounded dictionary and tables are sent to the tasks. Words outside the dictionary meet their
counts by 64-bit hashes, next tokens are told apart by 24 bits.

Defined results: null text is empty (one end token); rows that repeat an id are scored each, as documents of their own;
a null id counts as not held out; with no training text every word is spelled with even odds and the base score is 0
for each token; extra columns are ignored. Scores don't depend on how rows are dealt to tasks, but for the last digits
of the fitted weights.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, as_bytes, batches, use_only, worker_cache
from .lang_id import held_out

#: Words in the dictionary (longer ones than WORD_BYTES are spelled), entries of a summed chunk.
WORDS, WORD_BYTES, CHUNK = 262_144, 48, 1 << 16
#: Bits of a hashed table: as many as give it an entry for each TOKENS_AN_ENTRY training tokens, within bounds.
LEAST_BITS, MOST_BITS, TOKENS_AN_ENTRY = 20, 22, 128
#: One training document (and one word to be spelled) in so many fits the mixing weights.
TUNING = 32
#: Bytes of text that are worked on at once, when counting and when scoring.
COUNTED, PIECE = 1 << 19, 1 << 21
#: Bytes of text that are split at once, and whose words are looked up at once (each time a table of the dictionary is built).
READ, LOOKED = 1 << 23, 1 << 25
#: Tokens of these first ranks tell a text's language.
FREQUENT = 64
ROUNDS = 4
#: Steps of the weights along their gradient, of tokens and of spelled letters.
RATES = (0.012, 0.002)
#: Entries that a task holds before they are passed on or counted.
HELD = 1 << 22
#: A long context of more training tokens is no owner's: what follows it is summed up by all tasks. (At most 2^16 contexts are.)
HOT, _NONE = 1 << 17, 1 << 30
#: Tokens of a long context, contexts of a chunk, bits of the sketch that finds frequent ones.
LONG, OWNED, SKETCH = 3, 1 << 21, 20
_NODE, _SPIN = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Steps of a stretched prediction: a power of two, so weights can be kept in parts of it without rounding.
UNIT = 256
#: Symbols that weights are fitted on at once: a processor's cache holds their decisions.
FITTED = 1 << 11
#: Documents whose tokens (whose spelled words' letters) are priced step by step at once.
TOGETHER = (64, 256)
_START = np.array([0.3, 0.4, 0.4])


@dataclass
class Code:
    """A Huffman tree: for each symbol where its path begins and how long it is; for each step the node, the branch taken (bit 2) and a class of its depth (bits 0 and 1); for each node the weights of its branches and its slot.

    Slots spread the nodes over 32 bits; the 15 nodes of four levels that hang on one have theirs side by side, so a path meets few lines of a table.
    """

    first: np.ndarray
    length: np.ndarray
    path: np.ndarray
    weights: np.ndarray
    slots: np.ndarray


def huffman(weights: list[int]) -> Code:
    n = len(weights)
    total = [*weights, *[0] * (n - 1)]
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
    split = np.zeros((n - 1, 2), np.int64)
    for k in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], side[y], total[k] = k, k, 1, a + b
        split[2 * n - 2 - k] = a, b
        heapq.heappush(heap, (a + b, k))
    up, turn, root = np.array(parent), np.array(side), 2 * n - 2
    # all symbols climb to the root together
    at, size, climbed = np.arange(n), np.zeros(n, np.int32), []
    while len(going := np.nonzero(at != root)[0]):
        climbed.append((going, (root - up[at[going]]) << 3 | turn[at[going]] << 2))  # the root is node 0
        at[going] = up[at[going]]
        size[going] += 1
    first = np.cumsum(size) - size
    path = np.empty(int(size.sum()), np.uint32)
    for t, (symbols, step) in enumerate(climbed):
        depth = size[symbols] - 1 - t
        path[first[symbols] + depth] = step | np.minimum(depth >> 2, 3)
    # level by level from the root: the node that four levels hang on, and the place among them (1 to 15)
    over, place, level = [0] * (n - 1), [1] * (n - 1), [0] * (n - 1)
    for k in range(1, n - 1):  # a node's number is above its parent's
        a = root - parent[root - k]
        level[k] = level[a] + 1
        if level[k] % 4:
            over[k], place[k] = over[a], 2 * place[a] + side[root - k]
        else:
            over[k] = k
    over, place = np.array(over, np.uint32), np.array(place, np.uint32)
    mixed = (over + np.uint32(1)) * _NODE
    mixed = (mixed ^ (mixed >> np.uint32(15))) * _SPIN
    slots = (mixed ^ (mixed >> np.uint32(13))) & np.uint32(0xFFFF_FFF0) | place
    return Code(first.astype(np.int32), size, path, split, slots)


@dataclass
class Stream:
    """Symbols of documents one after another: symbol, document, place in its document, contexts."""

    sym: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    contexts: tuple

    def __len__(self) -> int:
        return len(self.sym)


@dataclass
class Tokens:
    """Tokens of several texts: ids, texts' sizes, and the words to be spelled with where they stand."""

    ids: np.ndarray
    sizes: np.ndarray
    spelled: list[bytes]
    at: np.ndarray

    def part(self, lo: int, hi: int) -> Tokens:
        """Of the texts from lo to hi."""
        a, b = self.sizes[:lo].sum(), self.sizes[:hi].sum()
        s, e = np.searchsorted(self.at, (a, b)).tolist()
        return Tokens(self.ids[a:b], self.sizes[lo:hi], self.spelled[s:e], self.at[s:e] - a)


@dataclass
class Laid:
    """Symbols in the order of their coding: where each one's decisions begin (and all end), how many they are, how far its path is from there, the hash of each context."""

    begin: np.ndarray
    size: np.ndarray
    path: np.ndarray
    hashes: list[np.ndarray]


class Coder:
    """Dictionary, trees and table layout; symbols of texts with their contexts."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, ends: int, letters: list[int], bits: int = LEAST_BITS):
        self.words = pa.array(words, pa.binary())
        self.end, self.escape = len(words), len(words) + 1
        self.token_code = huffman([*counts, max(1, ends), max(1, tokens - ends - sum(counts))])
        self.byte_code = huffman([x + 1 for x in letters])
        self.direct, self.bits = len(words) + 2, bits
        #: Paths with the nodes' slots in place of the nodes: what a decision needs lies next to that of the one before.
        self.steps = [(code.slots & np.uint32((1 << bits) - 1)).take(code.path >> np.uint32(3)) << np.uint32(3) | code.path & np.uint32(7) for code in (self.token_code, self.byte_code)]
        #: Where the tables of the token decisions' and of the byte decisions' contexts begin.
        self.at = ((0, self.direct, self.direct + (1 << bits)), tuple(self.direct + (k << bits) for k in (2, 3, 4)))
        self.size = self.direct + (5 << bits)

    def counted(self, k: int) -> tuple[int, int]:
        """Where the counted tables of stream k begin and how many entries they have (of token nodes alone, the tree has the counts)."""
        return self.at[k][1 - k], (2 + k) << self.bits

    def read(self, texts: list[bytes]) -> Tokens:
        words, counts = split_words(texts)
        return self.found(words, counts, pc.index_in(words, value_set=self.words))

    def found(self, words: pa.Array, counts: np.ndarray, found: pa.Array) -> Tokens:
        """Tokens of texts from their words, how many each text has, and the words' places in the dictionary."""
        ids = np.full(len(words) + len(counts), self.end, np.uint32)
        known = np.ones(len(ids), bool)
        known[np.cumsum(counts + 1) - 1] = False
        ids[known] = found.fill_null(self.escape).to_numpy(zero_copy_only=False)
        return Tokens(ids, counts + 1, listed(words.filter(found.is_null())), np.nonzero(ids == self.escape)[0])

    def parts(self, texts: list[bytes], most: int) -> Iterator[tuple[int, int, Tokens]]:
        """Texts' tokens, about ``most`` bytes at a time; words are looked up for more at once."""
        for a, b in _runs(texts, LOOKED):
            runs = [(a + lo, a + hi) for lo, hi in _runs(texts[a:b], READ)]
            read = [split_words(texts[lo:hi]) for lo, hi in runs]
            found, at = pc.index_in(pa.chunked_array([words for words, _ in read], pa.binary()), value_set=self.words).combine_chunks(), 0
            for (first, last), (words, counts) in zip(runs, read):
                t = self.found(words, counts, found.slice(at, len(words)))
                at += len(words)
                yield from ((first + lo, first + hi, t.part(lo, hi)) for lo, hi in _runs(texts[first:last], most))

    def tokens(self, t: Tokens) -> Stream:
        ids, sizes = t.ids, t.sizes
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # spelled words are told apart by their last bytes when they are a context
        kind = ids.copy()
        if t.spelled:
            kind[t.at] = np.uint32(self.escape + 1) + (tails(t.spelled) & np.uint32(4095))
        first = np.cumsum(sizes) - sizes
        one = np.empty_like(kind)
        one[1:], one[0] = kind[:-1], 0
        one[first] = 0xFFFF_0000
        # the last two frequent tokens of the text so far tell its language
        every = np.arange(len(ids), dtype=np.int32)
        begin = np.repeat(first.astype(np.int32), sizes)
        last = np.maximum.accumulate(np.where(ids < FREQUENT, every, np.int32(-1)))
        last[1:], last[0] = last[:-1].copy(), -1
        near = np.where(last >= begin, ids[last], FREQUENT).astype(np.uint32)
        cue = near * np.uint32(FREQUENT + 1) + np.where(last >= begin, near[last], FREQUENT).astype(np.uint32)
        a = (cue + np.uint32(1)) * np.uint32(0xC2B2AE35)
        b = one * np.uint32(0x27D4EB2F) + np.uint32(2)
        return Stream(ids.astype(np.int32), doc, every - begin, (None, a ^ (a >> np.uint32(15)), b ^ (b >> np.uint32(13))))

    @staticmethod
    def letters(words: list[bytes], owner: np.ndarray | None = None) -> tuple[Stream, np.ndarray]:
        """Byte symbols of words, by the document they are in (ascending; None: each word is one), and where each word begins."""
        raw = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(length) - length
        place = np.arange(len(raw)) - np.repeat(begin, length)
        sym = raw.astype(np.int32)
        sym[raw == 10] = 256
        before = []
        for k in range(1, 6):
            p = np.full(len(raw), 257, np.uint32)
            ok = place[k:] >= k
            p[k:][ok] = raw[:-k][ok]
            before.append(p)
        h2 = before[0] * np.uint32(0xC2B2AE35) + before[1] * np.uint32(0x27D4EB2F) + np.uint32(2)
        h3 = before[0] * np.uint32(0x165667B1) + before[1] * np.uint32(0xC2B2AE35) + before[2] * np.uint32(0x9E3779B1) + np.uint32(3)
        h5 = (h3 ^ (h3 >> np.uint32(14))) * np.uint32(0xC2B2AE35) + before[3] * np.uint32(0x27D4EB2F) + before[4] * np.uint32(0x85EBCA77)
        if owner is None:
            doc = np.repeat(np.arange(len(words), dtype=np.int32), length)
        else:
            doc = np.repeat(owner.astype(np.int32), length)
            new = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1])
            place = np.arange(len(raw)) - np.repeat(new, np.diff(np.concatenate([new, [len(raw)]])))
        return Stream(sym, doc, place.astype(np.int32), (h2 ^ (h2 >> np.uint32(13)), h3 ^ (h3 >> np.uint32(13)), h5 ^ (h5 >> np.uint32(13)))), begin

    def streams(self, k: int, items: list[bytes]) -> Iterator[Stream]:
        """Symbols of texts (k = 0) or words (k = 1), about COUNTED bytes at a time."""
        if k:
            yield from (self.letters(items[lo:hi])[0] for lo, hi in _runs(items, COUNTED))
        else:
            yield from (self.tokens(t) for _, _, t in self.parts(items, COUNTED))

    def laid(self, k: int, stream: Stream, pick: np.ndarray | None = None) -> Laid:
        """The picked symbols of stream k in that order."""
        sym = stream.sym if pick is None else stream.sym.take(pick)
        code, mask, hashes = self.byte_code if k else self.token_code, np.uint32((1 << self.bits) - 1), []
        size = code.length.take(sym)
        begin = np.append(0, np.cumsum(size, dtype=np.intp))
        for c in stream.contexts:
            if c is not None:
                h = (c if pick is None else c.take(pick)) * _SPIN
                h ^= h >> np.uint32(15)
                h &= mask
                hashes.append(h.astype(np.intp))
        return Laid(begin, size, code.first.take(sym) - begin[:-1], hashes)

    def along(self, k: int, laid: Laid, a: int, b: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each decision of the symbols from a to b: its place in the paths, the entry in each hashed table, the branch taken, a class of its depth."""
        size = laid.size[a:b]
        path = np.arange(laid.begin[a], laid.begin[b])
        path += np.repeat(laid.path[a:b], size)
        step = self.steps[k].take(path, mode="clip")  # all are within the paths: "clip" spares a second look
        slot, entries = (step >> np.uint32(3)).astype(np.intp), []
        for h in laid.hashes:
            entry = np.repeat(h[a:b], size)
            entry ^= slot
            entries.append(entry)
        step = step.astype(np.uint8)
        return path, entries, step >> np.uint8(2) & np.uint8(1), step & np.uint8(3)

    def walk(self, k: int, stream: Stream, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the picked symbols of stream k: where each one's decisions begin and how many they are; of each decision what ``along`` says."""
        laid = self.laid(k, stream, pick)
        return laid.begin[:-1], laid.size, *self.along(k, laid, 0, len(laid.size))

    @staticmethod
    def tallied(keys: list[np.ndarray], most: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pairs of symbol (upper half) and context (lower half), in order and some at a time: the symbol, the context and how often the pair occurs."""
        every = np.concatenate(keys)
        every.sort()
        at = np.nonzero(np.append(True, every[1:] != every[:-1]))[0] if len(every) else np.empty(0, np.int64)
        n = np.diff(np.append(at, len(every))).astype(np.int32)
        for lo in range(0, len(at), most):
            pair = every[at[lo : lo + most]]
            yield (pair >> np.uint64(32)).astype(np.int32), pair.astype(np.uint32), n[lo : lo + most]

    def decisions(self, k: int, stream: Stream, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """``walk`` with the entry of each context in the one table of all: begin, size, entries, branch, class of depth."""
        begin, size, path, entries, bit, depth = self.walk(k, stream, pick)
        if k == 0:
            entries.insert(0, (self.token_code.path.take(path) >> np.uint32(3)).astype(np.intp))
        return begin, size, [e + at for e, at in zip(entries, self.at[k])], bit, depth


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of the texts, one text after another, and how many each has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words = found.flatten().view(pa.binary())
    some = pc.greater(pc.binary_length(words), 0)  # blanks around a text leave an empty word there
    here = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = found.offsets.to_numpy() - found.offsets[0].as_py()
    return words.filter(some), np.diff(here[ends])


def listed(words: pa.Array) -> list[bytes]:
    """Words (none empty) as a list."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().split(b" ") if len(words) else []


def tails(words: list[bytes]) -> np.ndarray:
    """A number from the last two bytes of each word (of one or more)."""
    raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 2
    one, two = raw[end].astype(np.uint32), raw[np.maximum(end - 1, 0)].astype(np.uint32)
    two[0] = two[0] if len(words[0]) > 1 else 0
    return np.where(two > 0, two | one << np.uint32(8), one) * np.uint32(40503) >> np.uint32(4)


def table_bits(tokens: int) -> int:
    """Bits of each hashed table for so many training tokens."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, tokens / TOKENS_AN_ENTRY)))))


# -- long contexts -------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def id_marks(ids: np.ndarray) -> np.ndarray:
    """Marks of the tokens that have an id of their own (those of spelled words are their hashes)."""
    return _mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def contexts_before(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the LONG tokens before each place, from the tokens' marks."""
    h = np.zeros(len(at), np.uint64)
    for k in range(1, LONG + 1):
        h = (h + mark[at - k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return _mix(h)


def long_contexts(t: Tokens, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens with LONG others before them in their text: where they stand, the hash of those, their own hash. hashes: of the spelled words."""
    mark = id_marks(t.ids)
    mark[t.at] = hashes
    place = np.arange(len(mark)) - np.repeat(np.cumsum(t.sizes) - t.sizes, t.sizes)
    at = np.nonzero(place >= LONG)[0]
    return at, contexts_before(mark, at), mark[at]


def word_marks(coder: Coder, words: pa.Array) -> np.ndarray:
    """Marks of words, whether in the dictionary or not."""
    found = pc.index_in(words, value_set=coder.words)
    mark = id_marks(found.fill_null(0).to_numpy(zero_copy_only=False))
    out = found.is_null()
    mark[out.to_numpy(zero_copy_only=False)] = word_hashes(listed(words.filter(out)))
    return mark


def contexts_of(coder: Coder, words: pa.Array, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """``long_contexts`` of the tokens with LONG of these words before them, without a look at what the other words are: where they stand, the hash of the words, the text they are in; the last gives some of the tokens' own hashes."""
    found, counts = split_words(texts)
    doc = np.repeat(np.arange(len(texts)), counts + 1)
    inside = np.ones(len(doc), bool)
    inside[np.cumsum(counts + 1) - 1] = False  # ends
    which = np.full(len(doc), -1, np.int32)
    which[inside] = pc.index_in(found, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
    run = which >= 0
    for k in range(1, LONG):
        run[k:] &= which[: len(which) - k] >= 0
    at = np.nonzero(run[LONG - 1 : -1])[0] + LONG  # ends keep texts apart

    def token(some: np.ndarray) -> np.ndarray:
        place = at[some]
        mark = id_marks(np.full(len(place), coder.end))
        words_before = place - doc[place]
        mark[inside[place]] = word_marks(coder, found.take(pa.array(words_before[inside[place]])))
        return mark

    return at, contexts_before(np.append(word_marks(coder, words), np.uint64(0))[which], at), doc[at], token


def agreement(h: np.ndarray, token: np.ndarray, doc: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry (context, its next token, document; those of a document next to each other) whether all other training documents that have the context agree on what follows.

    kind: -1 if they don't or there are none, else 0 to 3 for 1, 2, up to 4 or more places; hit: whether the token is the one.
    """
    low = np.argsort(h.astype(np.uint16), kind="stable")
    order = low[np.argsort((h >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]
    out_kind, out_hit, h = np.full(len(h), -1, np.int8), np.zeros(len(h), bool), h[order]
    new = np.append(True, h[1:] != h[:-1])
    more = np.nonzero(~(new & np.append(new[1:], True)))[0]  # most contexts are met once and have no others
    if not len(more):
        return out_kind, out_hit
    order, h, new = order[more], h[more], new[more]
    token, doc, train = token[order].astype(np.int32), doc[order], train[order]
    part = new.copy()
    part[1:] |= doc[1:] != doc[:-1]
    at = np.nonzero(part)[0]  # where a document's entries of a context begin
    size = np.diff(np.concatenate([at, [len(h)]]))
    own = np.where(train[at], size, 0)
    first = np.nonzero(new[at])[0]
    run = np.cumsum(new[at]) - 1
    others = np.add.reduceat(own, first)[run] - own
    ends = []
    for sign in (1, -1):  # the least and the largest token of the other documents
        v = np.where(train[at], np.minimum.reduceat(sign * token, at), 1 << 30)
        least = np.minimum.reduceat(v, first)[run]
        mine = v == least
        alone = np.add.reduceat(mine.astype(np.int32), first)[run] == 1
        second = np.minimum.reduceat(np.where(mine, 1 << 30, v), first)[run]
        ends.append(sign * np.where(mine & alone, second, least))
    kind = np.where((others > 0) & (ends[0] == ends[1]), (others > 1).astype(np.int8) + (others > 2) + (others > 4), -1)
    out_kind[order] = np.repeat(kind, size)
    out_hit[order] = (np.repeat(ends[0], size) == token) & np.repeat(kind >= 0, size)
    return out_kind, out_hit


def trust(kind: np.ndarray, hit: np.ndarray, train: np.ndarray) -> np.ndarray:
    """How many training entries there are of each kind, and how many of them are hits."""
    return np.stack([np.bincount(kind[some & train], minlength=4) for some in (kind >= 0, hit)])


def gains(kind: np.ndarray, hit: np.ndarray, train: np.ndarray, cost: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """What each entry's code gets shorter (natural log), given what the token costs otherwise; by the trust of these entries if none is given."""
    some = kind >= 0
    count, right = trust(kind, hit, train) if seen is None else seen
    p = (right + 0.4) / (count + 0.8)
    out = np.zeros(len(kind))
    out[hit] = np.log(p)[kind[hit]] + cost[hit]
    miss = some & ~hit
    out[miss] = np.log(1 - p)[kind[miss]]
    return out


def two_least(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct h in order, and the two least v of each (_NONE for a second one that isn't there)."""
    order = np.lexsort((v, h))
    h, v = h[order], np.append(v[order], _NONE)
    at = np.nonzero(np.append(True, h[1:] != h[:-1]))[0] if len(h) else np.empty(0, np.int64)
    return h[at], v[at], np.where(np.diff(np.append(at, len(h))) > 1, v[at + 1], _NONE)


def by_document(h: np.ndarray, doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order of entries by context and document; of each pair of these: context, document, how many entries, the least token and the least of the negative ones."""
    order = np.lexsort((doc, h))
    h, doc, token = h[order], doc[order], token[order]
    at = np.nonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[0]
    return order, h[at], doc[at], np.diff(np.append(at, len(h))), np.minimum.reduceat(token, at), np.minimum.reduceat(-token, at)


@dataclass
class Hot:
    """The cells of the sketch that have frequent contexts; these in order, each with the training tokens that follow it: how many, the two least of the documents' least ones, the same of the negative ones; their trust."""

    cells: np.ndarray
    h: np.ndarray
    n: np.ndarray
    least: np.ndarray
    most: np.ndarray
    seen: np.ndarray

    def within(self, h: np.ndarray) -> np.ndarray:
        """Which contexts may be frequent: those in the cells; where the contexts are known, exactly which are."""
        some = np.nonzero(np.isin((h >> np.uint64(64 - SKETCH)).astype(np.int64), self.cells))[0] if len(self.cells) else np.empty(0, np.int64)
        return some[np.isin(h[some], self.h)] if len(self.h) else some

    def agreement(self, h: np.ndarray, token: np.ndarray, doc: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``agreement`` of entries of frequent contexts, from the sums. train: of each document."""
        out_kind, out_hit = np.empty(len(h), np.int8), np.empty(len(h), bool)
        if not len(h):
            return out_kind, out_hit
        order, key, d, size, low, high = by_document(h, doc, token)
        at, own = np.searchsorted(self.h, key), train[d]
        others = self.n[at] - np.where(own, size, 0)
        # the least of the other documents' tokens: the second one where this document has the least
        low = np.where(own & (low == self.least[0, at]), self.least[1, at], self.least[0, at])
        high = -np.where(own & (high == self.most[0, at]), self.most[1, at], self.most[0, at])
        kind = np.where((others > 0) & (low == high), (others > 1).astype(np.int8) + (others > 2) + (others > 4), -1)
        out_kind[order], out_hit[order] = np.repeat(kind, size), np.repeat(low, size) == token[order]
        return out_kind, out_hit & (out_kind >= 0)


def hot_contexts(texts: DataFrame, counts: DataFrame, coding: _Shared, cells: np.ndarray, most: int) -> Hot:
    """Sum up what follows the contexts of over ``most`` tokens in training texts (column ``x``), all of which are in the cells and made of words that occur over ``most`` times themselves (by ``counts(word, c)``)."""
    none = np.zeros((2, 4), np.int64)
    found = Hot(cells, *(np.empty(0, x) for x in (np.uint64, np.int64)), *np.empty((2, 2, 0), np.int64), none)
    if not len(cells):
        return found
    context = texts.sparkSession.sparkContext
    often = counts.where((F.col("c") > most) & (F.octet_length("word") > 0)).select("word").collect()  # at most one for each ``most`` training tokens
    if not often:
        return Hot(np.empty(0, np.int64), found.h, found.n, found.least, found.most, none)
    words = context.broadcast([bytes(r.word) for r in often])

    def entries(it: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        coder = _of(coding, lambda v: Coder(*v))
        frequent = pa.array(words.value, pa.binary())
        for batch in batches(it):
            every = as_bytes(batch.column("x"))
            for lo, hi in _runs(every, READ):
                _, h, doc, token = contexts_of(coder, frequent, every[lo:hi])
                some = hot.within(h)
                if len(some):
                    yield h[some], doc[some], (token(some) >> np.uint64(40)).astype(np.int64)

    def summed(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        h, n, low, low2, high, high2 = (np.concatenate(x) for x in zip(*rows))
        key, *least = two_least(np.append(h, h), np.append(low, low2))
        _, *greatest = two_least(np.append(h, h), np.append(high, high2))
        total = np.zeros(len(key), np.int64)
        np.add.at(total, np.searchsorted(key, h), n)
        return key, total, *least, *greatest

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            h, n, low, low2, high, high2 = summed(rows)
            pair = lambda a, b: pa.FixedSizeListArray.from_arrays(pa.array(np.stack([a, b], 1).ravel()), 2).cast(pa.list_(pa.int64()))
            rows.clear()
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n), pair(low, low2), pair(high, high2)], ["h", "n", "least", "most"])

        for h, doc, token in entries(it, found):
            _, key, _, size, low, high = by_document(h, doc, token)
            rows.append((key, size, low, np.full(len(key), _NONE), high, np.full(len(key), _NONE)))
            if sum(len(x[0]) for x in rows) > HELD // 8:
                rows[:] = [summed(rows)]
                if len(rows[0][0]) > HELD // 16:
                    yield emit()
        if rows:
            yield emit()

    least = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, 2).alias(c)  # noqa: E731 - a row of each task
    sums = texts.select("x").mapInArrow(count, "h long, n long, least array<long>, most array<long>").groupBy("h").agg(F.sum("n").alias("n"), least("least"), least("most"))
    top = sums.where(F.col("n") > most).collect()  # at most one for each ``most`` training tokens
    if not top:
        return Hot(np.empty(0, np.int64), found.h, found.n, found.least, found.most, none)
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    hot = Hot(cells, h[order], np.array([r.n for r in top])[order], *(np.array([r[c] for r in top]).T[:, order] for c in ("least", "most")), none)
    hot.seen = none.copy()
    # the least and the greatest token of the documents but one are among these; where none are equal, no documents agree
    if not any((low == -high).any() for low in hot.least for high in hot.most):
        return hot
    now = context.broadcast(hot)

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 4), np.int64)
        for h, doc, token in entries(it, now.value):
            train = np.ones(doc.max() + 1, bool)
            kind, hit = now.value.agreement(h, token, doc, train)
            total += trust(kind, hit, train[doc])
        yield pa.record_batch([pa.array(np.arange(8)), pa.array(total.ravel())], ["i", "v"])

    for r in texts.select("x").mapInArrow(weigh, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        hot.seen[divmod(r.i, 4)] = r.v
    return hot


# -- counting ------------------------------------------------------------------------------------


def _vocabulary(docs: DataFrame) -> DataFrame:
    """word, c of all tokens of the documents (the end token is the empty word)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(None)
        held: list[pa.Table] = []
        ends = rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches(it):
            texts = as_bytes(batch.column("text"))
            ends += len(texts)
            for lo, hi in _runs(texts, READ):
                found = split_words(texts[lo:hi])[0].value_counts()
                held.append(pa.table([*found.flatten()], ["word", "c"]))
                rows += len(found)
                if rows > 1 << 19:
                    held[:] = [summed()]
                    rows = held[0].num_rows
                    if rows > 1 << 18:
                        yield from held.pop().to_batches(max_chunksize=50_000)
                        rows = 0
        if held:
            yield from summed().to_batches(max_chunksize=50_000)
        yield pa.record_batch([pa.array([b""] if ends else [], pa.binary()), pa.array([ends] if ends else [], pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _letters(words: DataFrame) -> list[int]:
    """How often each byte, and the end (256), occurs in the words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, np.int64)
        for batch in batches(it):
            found = as_bytes(batch.column("word"))
            total[256] += len(found)
            total[:256] += np.bincount(np.frombuffer(b"".join(found), np.uint8), minlength=256)
        yield pa.record_batch([pa.array(np.arange(257)), pa.array(total)], ["s", "n"])

    out = [0] * 257
    for r in words.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        out[r.s] = r.n
    return out


_HERE: dict[int, object] = worker_cache({})


def _of(shared, make):
    """What a worker builds once from a broadcast."""
    use_only(_HERE)
    if shared.id not in _HERE:
        if len(_HERE) > 3:
            _HERE.clear()
        _HERE[shared.id] = make(shared.value)
    return _HERE[shared.id]


class _Shared:
    """A broadcast that knows its number on the workers too."""

    def __init__(self, context, value):
        self.held = context.broadcast(value)
        self.id = self.held._jbroadcast.id()

    @property
    def value(self):
        return self.held.value


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(a: np.ndarray) -> bytes:
    """Whole numbers, none below 0, in as few bytes as the largest needs, compressed."""
    size = next(n for n in (1, 2, 4, 8) if int(a.max(initial=0)) >> 8 * n == 0)
    data = a.astype(f"<u{size}").tobytes()
    return struct.pack("<BQ", size, len(data)) + _ZSTD.compress(data, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """What was packed, in 64 bits."""
    size, n = struct.unpack_from("<BQ", data)
    return np.frombuffer(_ZSTD.decompress(data[9:], n, asbytes=True), f"<u{size}").astype(np.int64) if n else np.empty(0, np.int64)


#: Tables are summed by stream (2: the sketch of long contexts), chunk and fold (1: what the weights are fitted on).
_KEYS = ["k", "chunk", "fold"]


def _tables(texts: DataFrame, words: DataFrame, shared: _Shared) -> DataFrame:
    """k, chunk, data: the tables' counts (branch 0 and 1 of each entry in turn) over all texts and words (columns ``x``; ``t`` marks what weights are fitted on), as states without and with what is marked; of the sketch, the counts."""

    def count(k: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _of(shared, lambda v: Coder(*v))
        size = coder.counted(k)[1]
        total: dict[tuple[int, int], np.ndarray] = {}
        # symbols are counted with their contexts first: what occurs again and again is walked once, and a symbol's path stays in a processor's cache
        held: dict[tuple[int, int, int], list[np.ndarray]] = {}
        waiting: dict[tuple[int, int, int], int] = {}
        salt = 0

        def table(k: int, fold: int, size: int) -> np.ndarray:
            if (k, fold) not in total:
                total[k, fold] = np.zeros(size, np.int32)
            return total[k, fold]

        def flush(key: tuple[int, int, int]) -> None:
            k, fold, c = key
            counts = table(k, fold, 2 * size)[c << (coder.bits + 1) : (c + 1) << (coder.bits + 1)]
            for sym, context, n in coder.tallied(held.pop(key)):
                _, steps, _, (e,), bit, _ = coder.walk(k, Stream(sym, sym, sym, (context,)))
                e <<= 1
                e |= bit
                np.add.at(counts, e, np.repeat(n, steps))
            waiting[key] = 0

        for batch in batches(it):
            items, marked = as_bytes(batch.column("x")), batch.column("t").to_numpy(zero_copy_only=False).astype(bool)
            salt ^= zlib.crc32(items[0])
            for fold in (0, 1):
                here = [x for x, m in zip(items, marked.tolist()) if m == fold]
                for part in _runs(here, COUNTED) if k else coder.parts(here, COUNTED):
                    if k:
                        stream = coder.letters(here[part[0] : part[1]])[0]
                    else:
                        tokens = part[2]
                        stream = coder.tokens(tokens)
                        cells = long_contexts(tokens, word_hashes(tokens.spelled))[1] >> np.uint64(64 - SKETCH)
                        np.add.at(table(2, 0, 1 << SKETCH), cells.astype(np.intp), np.int32(1))
                    for c, context in enumerate(x for x in stream.contexts if x is not None):
                        key = k, fold, c
                        held.setdefault(key, []).append(stream.sym.astype(np.uint64) << np.uint64(32) | context)
                        waiting[key] = waiting.get(key, 0) + len(stream)
                        if waiting[key] > HELD // 2:
                            flush(key)
        for key in list(held):
            flush(key)
        for (stream, fold), counts in total.items():
            for i in range(0, len(counts), CHUNK):
                part = counts[i : i + CHUNK]
                if part.any():
                    yield _summed(stream, i // CHUNK, fold, salt % 16, part)

    schema = "k int, chunk int, fold int, salt int, data binary"
    rows = texts.mapInArrow(partial(count, 0), schema).unionByName(words.mapInArrow(partial(count, 1), schema))
    by = [*_KEYS, "salt"]
    rows = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(partial(_add, by), schema)
    rows = rows.repartition("k", "chunk").sortWithinPartitions(*_KEYS)
    return rows.mapInArrow(_states, "k int, chunk int, without binary, data binary")


def _runs(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about ``most`` bytes, one item at least."""
    at, size = 0, 0
    for i, x in enumerate(items):
        if i > at and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(items):
        yield at, len(items)


def _summed(k: int, chunk: int, fold: int, salt: int, data: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([x], pa.int32()) for x in (k, chunk, fold, salt)]
    return pa.record_batch([*cols, pa.array([packed(data)], pa.binary())], [*_KEYS, "salt", "data"])


def _add(by: list[str], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum, in 64 bits, the counts that agree in ``by``."""
    at, total = None, None
    for batch in batches(it):
        for x in batch.to_pylist():
            key, part = tuple(x[c] if c in by else 0 for c in [*_KEYS, "salt"]), unpacked(x["data"])
            if key != at:
                if at:
                    yield _summed(*at, total)
                at, total = key, part
            else:
                total += part
    if at:
        yield _summed(*at, total)


def _states(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of each chunk, without and with what weights are fitted on; of the sketch, the counts."""
    at, sums = None, {}

    def close() -> pa.RecordBatch:
        whole = sum(sums.values())
        if at[0] == 2:
            data = [b"", packed(whole)]
        else:
            data = [zlib.compress(state(*n.reshape(-1, 2).T).tobytes(), 1) for n in (sums.get(0, 0 * whole), whole)]
        return pa.record_batch([*(pa.array([x], pa.int32()) for x in at), *(pa.array([x], pa.binary()) for x in data)], ["k", "chunk", "without", "data"])

    for x in (x for batch in _add(_KEYS, it) for x in batch.to_pylist()):
        if at is not None and at != (x["k"], x["chunk"]):
            yield close()
            sums = {}
        at = (x["k"], x["chunk"])
        sums[x["fold"]] = unpacked(x["data"])
    if at is not None:
        yield close()


def state(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of branch 1 in steps of 1/256 and, in the two low bits, how often the context was seen: never, below 4, below 32, more."""
    n = zeros + ones
    odds = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -15, 15)
    seen = (n > 0).astype(np.int16) + (n >= 4) + (n >= 32)
    return (np.rint(odds * 256).astype(np.int16) << 2 | seen).astype(np.int16)


# -- mixing --------------------------------------------------------------------------------------


def _inputs(k: int, seen: list[np.ndarray], depth: np.ndarray, here: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the contexts' states: stretched predictions in steps of 1/UNIT, and the gate of each decision (0 to 63, beyond the number ``here``)."""
    stretched = [(v >> 2).astype(np.float32) for v in seen]
    gate = (seen[1] & 3) | (seen[2] & 3) << 2 | (depth if k == 0 else seen[0] & 3).astype(np.int16) << 4
    if here is not None:
        gate |= here
    return stretched, gate.astype(np.intp)


def _steps(place: np.ndarray) -> np.ndarray:
    """Which step a symbol is in: steps of 16 symbols, beyond the 512th of 64, beyond the 4096th of 256."""
    return np.where(place < 512, place >> 4, np.where(place < 4096, 24 + (place >> 6), 72 + (place >> 8)))


def _taught(place: np.ndarray) -> np.ndarray:
    """Which symbols weights learn from where not ``every`` one teaches: of the long steps' the first quarter. No score is made so."""
    return np.where(place < 512, True, np.where(place < 4096, (place & 63) < 16, (place & 255) < 64))


def _lengths(wrong: np.ndarray, whole: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of log(1 + wrong) over each symbol's decisions: one logarithm of their product, or of each where that is too large."""
    with np.errstate(over="ignore"):
        out = np.log(np.multiply.reduceat(whole, begin, dtype=np.float64))
    if not np.isfinite(out).all():
        out = np.add.reduceat(np.log1p(wrong), begin, dtype=np.float64)
    return out


class Mixer:
    """Coder, context states and the weights that every text starts from."""

    def __init__(self, coder: Coder, table: bytes, weights: np.ndarray):
        self.coder = coder
        self.table = np.frombuffer(zlib.decompress(table), np.int16)
        #: The states of each context; of the nodes alone, along the paths.
        self.states = [[self.table[at : at + (1 << coder.bits)] for at in coder.at[k] if at] for k in range(2)]
        self.states[0].insert(0, self.table.take(coder.token_code.path >> np.uint32(3)))
        self.columns = [[np.ascontiguousarray(weights[k, :, i], np.float32) / np.float32(UNIT) for i in range(3)] for k in range(2)]

    def costs(self, k: int, stream: Stream, rate: float | None = None, every: bool = False) -> np.ndarray:
        """What each symbol costs (natural log), weights refined along each document: by ``every`` symbol, as scores are, else by those that ``_taught`` names."""
        rate = RATES[k] if rate is None else rate
        out = np.zeros(len(stream))
        if not len(stream):
            return out
        # documents of about one size go along together, as many as a processor's cache holds the decisions of
        first = np.nonzero(np.append(True, stream.doc[1:] != stream.doc[:-1]))[0]
        sizes = np.diff(np.append(first, len(out)))
        rank = np.empty(len(sizes), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        # by group and step, what teaches first
        step, most = _steps(stream.place), 2 * int(_steps(stream.place[first + sizes - 1].max())) + 2
        key = 2 * step
        if not every:
            key += ~_taught(stream.place)
        key += np.repeat(rank // TOGETHER[k] * most, sizes)
        order = np.argsort(key.astype(np.uint16) if (len(sizes) // TOGETHER[k] + 1) * most <= 1 << 16 else key, kind="stable")
        key, here = key[order], np.repeat((rank % TOGETHER[k] * 64).astype(np.int16), sizes)[order]
        at = np.nonzero(np.append(True, key[1:] >> 1 != key[:-1] >> 1))[0]
        teaching = np.add.reduceat(key & 1 ^ 1, at).tolist()
        groups, at, last = (key[at] // most).tolist(), [*at.tolist(), len(order)], -1
        laid, found = self.coder.laid(k, stream, order), np.empty(len(order))
        for r, learn in enumerate(teaching):
            a, b = at[r], at[r + 1]
            if groups[r] != last:
                last = groups[r]
                weights = [np.tile(c, TOGETHER[k]) for c in self.columns[k]]
            path, entries, bit, depth = self.coder.along(k, laid, a, b)
            seen = [states.take(e, mode="clip") for states, e in zip(self.states[k], entries if k else [path, *entries])]
            x, gate = _inputs(k, seen, depth, np.repeat(here[a:b], laid.size[a:b]))
            z = weights[0].take(gate, mode="clip") * x[0]
            z += weights[1].take(gate, mode="clip") * x[1]
            z += weights[2].take(gate, mode="clip") * x[2]
            sign = bit.astype(np.float32)
            sign += sign
            sign -= np.float32(1)
            z *= sign
            wrong = np.exp(np.minimum(np.negative(z, out=z), np.float32(30), out=z))
            whole = 1 + wrong
            found[a:b] = _lengths(wrong, whole, laid.begin[a:b] - laid.begin[a])
            if rate and b < len(order) and groups[r + 1] == last:
                m = int(laid.begin[a + learn] - laid.begin[a])
                error, gate, going = sign[:m] * wrong[:m] / whole[:m], gate[:m], int(here[a:b].max()) + 64
                for w, v in zip(weights, x):
                    w[:going] += (rate / UNIT**2 * np.bincount(gate, error * v[:m], going)).astype(np.float32)
        out[order] = found
        return out

    def score(self, texts: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """Tokens of the texts; what each token costs, its spelling included; what each spelling costs."""
        t = self.coder.read(texts)
        return t, *self.priced(t)

    def priced(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        stream = self.coder.tokens(t)
        cost = self.costs(0, stream, every=True)
        spelling = np.zeros(len(t.at))
        if t.spelled:
            letters, begin = self.coder.letters(t.spelled, stream.doc[t.at])
            spelling = np.add.reduceat(self.costs(1, letters, every=True), begin)
            cost[t.at] += spelling
        return cost, spelling


def _gather(k: int, items: DataFrame, coding: _Shared, table: _Shared, weights: np.ndarray) -> np.ndarray:
    """Gradient (3) and curvature (6) of each gate at these weights, summed over texts (k = 0) or words (1)."""
    now = items.sparkSession.sparkContext.broadcast(weights)
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, states = _of(coding, lambda v: Coder(*v)), _of(table, lambda v: np.frombuffer(zlib.decompress(v), np.int16))
        out, columns = np.zeros((9, 64)), np.ascontiguousarray(now.value.T, np.float32)
        for batch in batches(it):
            for stream, lo in ((stream, lo) for stream in coder.streams(k, as_bytes(batch.column("x"))) for lo in range(0, len(stream), FITTED)):
                _, _, entries, bit, depth = coder.decisions(k, stream, np.arange(lo, min(lo + FITTED, len(stream))))
                x, gate = _inputs(k, [states.take(e, mode="clip") for e in entries], depth)
                for v in x:
                    v /= np.float32(UNIT)
                p = columns[0].take(gate) * x[0] + columns[1].take(gate) * x[1] + columns[2].take(gate) * x[2]
                p = 1 / (1 + np.exp(-p))
                off, curve = bit - p, p * (1 - p)
                for i in range(3):
                    out[i] += np.bincount(gate, off * x[i], 64)
                curved = [curve * v for v in x]
                for j, (a, b) in enumerate(pairs):
                    out[3 + j] += np.bincount(gate, curved[a] * x[b], 64)
        yield pa.record_batch([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["i", "v"])

    out = np.zeros(9 * 64)
    for r in items.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.reshape(9, 64)


def fit_weights(k: int, items: DataFrame, coding: _Shared, table: _Shared, rounds: int = ROUNDS) -> np.ndarray:
    """Newton steps of the gated logistic regression, drawn towards the starting weights."""
    weights = np.tile(_START, (64, 1))
    for _ in range(rounds):
        got = _gather(k, items, coding, table, weights)
        for g in range(64):
            u, c = got[:3, g], got[3:, g]
            h = np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]) + 20 * np.eye(3)
            weights[g] += np.linalg.solve(h, u - 20 * (weights[g] - _START))
        weights = np.clip(weights, -1, 2)
    return np.round(weights, 4)


# -- training ------------------------------------------------------------------------------------


@dataclass
class Trained:
    """What scoring takes from the training documents: broadcasts for the tasks, totals, and the counts of words outside the dictionary (word, c)."""

    coding: _Shared
    states: _Shared
    weights: _Shared
    hot: _Shared
    rest: DataFrame
    spec: tuple
    tokens: int
    kinds: int


def trained(train: DataFrame, store: Store, words: int = WORDS) -> Trained:
    """Learn from ``train(doc_id, text)``."""
    context = train.sparkSession.sparkContext
    counts = store.put(_vocabulary(train), "counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    # the dictionary: words of the highest ranges of counts (sixteen to an octave) that fit in it together; words met
    # once are spelled, so that the escape and the spelling are learned where new words come
    level = F.floor(F.log2("c") * 16)
    short = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= WORD_BYTES) & (F.col("c") > 1))
    room, least = words, None
    for r in sorted(short.groupBy(level.alias("g")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r.g
    inside = (F.octet_length("word") <= WORD_BYTES) & (F.col("c") > 1) & (level >= least) if least is not None else F.lit(False)
    top = sorted(short.where(inside).collect(), key=lambda r: (-r.c, r.word))  # at most ``words`` rows
    rest = counts.where((F.octet_length("word") > 0) & ~inside)
    every = counts.where(F.octet_length("word") > 0)  # spelling is learned from all different words, those of the dictionary too
    spec = ([bytes(r.word) for r in top], [r.c for r in top], n, ends, _letters(every), table_bits(n))
    coding, coder = _Shared(context, spec), Coder(*spec)
    part = lambda *key: F.pmod(F.xxhash64(*key, F.lit(5)), F.lit(TUNING)) == 0
    texts = train.select(F.col("text").alias("x"), part(F.coalesce("doc_id", F.lit(-1))).alias("t"))
    spelled = every.select(F.col("word").alias("x"), part("word").alias("t"))
    tables = [np.zeros((-(-coder.size // CHUNK) + 1) * CHUNK, np.int16) for _ in range(2)]
    cells, most = [np.empty(0, np.int64)], min(max(HOT, n >> 16), 4 * OWNED)
    for r in _tables(texts, spelled, coding).toLocalIterator():  # as many chunks as the tables have
        if r.k == 2:
            cells.append(np.nonzero(unpacked(r.data) > most)[0] + r.chunk * CHUNK)
        else:
            at = coder.counted(r.k)[0] + r.chunk * CHUNK // 2
            for table, data in zip(tables, (r.without, r.data)):
                got = np.frombuffer(zlib.decompress(data), np.int16)
                table[at : at + len(got)] = got
    split = coder.token_code.weights
    for table in tables:
        table[: len(split)] = state(split[:, 0], split[:, 1])
    states = [zlib.compress(table[: coder.size].tobytes(), 1) for table in tables]
    tables.clear()
    before = _Shared(context, states[0])
    tuned = [store.put(x.where("t").select("x"), f"tuned{k}") for k, x in enumerate((texts, spelled))]  # read in every round
    weights = np.stack([fit_weights(k, x, coding, before) for k, x in enumerate(tuned)])
    before.held.destroy()
    hot = hot_contexts(texts, counts, coding, np.concatenate(cells), most)  # at most 2^16 cells
    return Trained(coding, _Shared(context, states[1]), _Shared(context, weights), _Shared(context, hot), rest, spec, n, v)


# -- the operator --------------------------------------------------------------------------------

_ROW = "piece long, chunk int, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_FACTS = ["held_out", "n_tokens", "known", "base", "score", "unseen", "bytes"]


def _row(piece: int, chunk: int, kind: int, *data: bytes) -> pa.RecordBatch:
    cols = [pa.array([piece]), pa.array([chunk], pa.int32()), pa.array([kind], pa.int32())]
    return pa.record_batch([*cols, *(pa.array([x], pa.binary()) for x in [*data, *[None] * (5 - len(data))])], _NAMES)


def _docs_out(doc: np.ndarray) -> bytes:
    return packed(np.diff(doc, prepend=0))


def _docs_in(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def scored(docs: DataFrame, store: Store, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte, unseen_score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(1, 5))
    return score_with(docs, trained(docs.where("not held_out"), store, words))


def score_with(docs: DataFrame, model: Trained) -> DataFrame:
    """``scored`` of ``docs(doc_id, text, held_out)``; those not held out are what the model has learned from."""
    n, ends, top = model.tokens, model.spec[3], model.spec[1]
    coding, states, weights, frequent = model.coding, model.states, model.weights, model.hot
    low = 0.5 * (model.kinds + 1) + n
    chunks = max(1, -(-(n + n // 4) // OWNED))

    def deal(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) * np.uint64(chunks) >> np.uint64(24)).astype(np.int64)

    def parts(chunk: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(chunk.astype(np.uint16) if chunks < 1 << 16 else chunk, kind="stable")
        ends = np.searchsorted(chunk[order], np.arange(chunks + 1)) if chunks < 4 * len(order) else None
        if ends is not None:
            yield from ((c, order[ends[c] : ends[c + 1]]) for c in range(chunks) if ends[c + 1] > ends[c])
        elif len(order):
            new = np.concatenate([[0], np.nonzero(np.diff(chunk[order]))[0] + 1, [len(order)]])
            yield from ((int(chunk[order[a]]), order[a:b]) for a, b in zip(new[:-1].tolist(), new[1:].tolist()))

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each piece: one row with what is known here, one for each chunk that has its contexts or words."""
        from pyspark import TaskContext

        mixer = _of(weights, lambda w: Mixer(_of(coding, lambda v: Coder(*v)), states.value, w))
        coder = mixer.coder
        worth = np.log10((np.array([*top, ends, 0]) + 0.5) / low)
        hot: Hot = frequent.value
        piece = TaskContext.get().partitionId() << 36
        for batch in batches(it):
            texts, held = as_bytes(batch.column("text")), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, t in coder.parts(texts, PIECE):
                cost, spelling = mixer.priced(t)
                m, train = hi - lo, ~held[lo:hi]
                doc, known = np.repeat(np.arange(m), t.sizes), t.ids != coder.escape
                facts = [
                    held[lo:hi], t.sizes, np.bincount(doc[known & ((t.ids != coder.end) | (ends > 0))], minlength=m), np.bincount(doc[known], worth[t.ids[known]], m), -np.bincount(doc, cost, m), np.zeros(m),
                    np.array([len(x) for x in texts[lo:hi]]),
                ]
                ids = pa.record_batch([batch.column("doc_id").slice(lo, m)], ["doc_id"])
                hashes = word_hashes(t.spelled)
                at, h, token = long_contexts(t, hashes)
                some = hot.within(h)
                if len(some):
                    d, y = doc[at[some]], (token[some] >> np.uint64(40)).astype(np.int64)
                    kind, hit = hot.agreement(h[some], y, d, train)
                    facts[4] += np.bincount(d, gains(kind, hit, train[d], cost[at[some]], hot.seen), m)
                    at, h, token = (np.delete(x, some) for x in (at, h, token))
                yield _row(piece, piece % chunks, 0, _frame(ids), np.stack(facts).astype("<f8").tobytes())
                mark, price = doc[at] * 2 + train[doc[at]], rounded(cost[at])
                token, h32 = (token >> np.uint64(20)).astype(np.uint32), (h & np.uint64(0xFFFF_FFFF)).astype(np.uint32)
                for c, x in parts(deal(h)):
                    y = token[x]
                    yield _row(piece, c, 1, h32[x].tobytes(), y.astype(np.uint16).tobytes(), (y >> np.uint32(16)).astype(np.uint8).tobytes(), price[x].tobytes(), _docs_out(mark[x]))
                for c, x in parts(deal(hashes)):
                    yield _row(piece, c, 2, hashes[x].tobytes(), _docs_out(doc[t.at[x]]), spelling[x].astype("<f4").tobytes())
                piece += 1

    def list_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of words outside the dictionary, by chunk."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            h, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for chunk, x in parts(deal(h)):
                yield _row(-1, chunk, 3, h[x].tobytes(), c[x].tobytes())

        for batch in batches(it):
            found = as_bytes(batch.column("word"))
            held.append((np.fromiter(map(word_hash, found), np.uint64, len(found)), batch.column("c").to_numpy()))
            if sum(len(h) for h, _ in held) > HELD // 8:
                yield from emit()
        if held:
            yield from emit()

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(None)
        held: list[dict] = []
        for batch in batches(it):
            for x in batch.to_pylist():
                if held and held[0]["chunk"] != x["chunk"]:
                    yield from _owned(held, low)
                    held = []
                if x["kind"]:
                    held.append(x)
                else:
                    yield _row(x["piece"], x["chunk"], 0, x["a"], x["b"])
        if held:
            yield from _owned(held, low)

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(send, _ROW).unionByName(model.rest.mapInArrow(list_words, _ROW))
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "piece", "kind").mapInArrow(own, _ROW)
    rows = rows.repartition("piece").sortWithinPartitions("piece", "kind", "chunk")
    out = rows.mapInArrow(_gathered, "doc_id long, " + ", ".join(f"{x} double" for x in _FACTS))
    log2 = -F.col("score") / math.log(2) / F.greatest("bytes", F.lit(1.0))
    return out.select(
        "doc_id", (F.col("held_out") > 0).alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("score") / math.log(10)).alias("score"), log2.alias("bits_per_byte"), (F.col("unseen") / math.log(10)).alias("unseen_score"),
    )


def rounded(cost: np.ndarray) -> np.ndarray:
    """Costs in two bytes: single precision without its lower half, so that none is too large."""
    return ((cost.astype(np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)


def unrounded(cost: np.ndarray) -> np.ndarray:
    return (cost.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def _frame(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _owned(held: list[dict], low: float) -> Iterator[pa.RecordBatch]:
    """What a chunk's contexts and words bring to the documents of each piece: rows of kind 1 with (document, gain), of kind 2 with (document, words known, base, spelling of words never seen)."""
    entries = [x for x in held if x["kind"] == 1]
    if entries:
        h = np.frombuffer(b"".join(x["a"] for x in entries), np.uint32)
        token = np.frombuffer(b"".join(x["b"] for x in entries), np.uint16).astype(np.int32) | np.frombuffer(b"".join(x["c"] for x in entries), np.uint8).astype(np.int32) << 16
        marks = [_docs_in(x["e"]) for x in entries]
        first = np.cumsum([0, *(int(m[-1] >> 1) + 1 for m in marks)])
        mark = np.concatenate(marks)
        doc, train = np.concatenate([(m >> 1) + f for m, f in zip(marks, first.tolist())]), (mark & 1).astype(bool)
        kind, hit = agreement(h, token, doc, train)
        cost = unrounded(np.frombuffer(b"".join(x["d"] for x in entries), np.uint16))
        gain = np.bincount(doc, gains(kind, hit, train, cost), int(first[-1]))
        del h, token, marks, mark, doc, kind, hit, cost
        for x, a, b in zip(entries, first[:-1].tolist(), first[1:].tolist()):
            some = np.nonzero(gain[a:b])[0]
            if len(some):
                yield _row(x["piece"], x["chunk"], 1, _docs_out(some), gain[a:b][some].astype("<f4").tobytes())
    asked = [x for x in held if x["kind"] == 2]
    if asked:
        known = [x for x in held if x["kind"] == 3]
        h = np.frombuffer(b"".join(x["a"] for x in known), np.uint64)
        c = np.frombuffer(b"".join(x["b"] for x in known), np.int64)
        order = np.argsort(h)
        h, c = np.append(h[order], np.uint64((1 << 64) - 1)), np.append(c[order], 0)
        for x in asked:
            q = np.frombuffer(x["a"], np.uint64)
            at = np.searchsorted(h, q)
            n = np.where(h[at] == q, c[at], 0)
            doc, inverse = np.unique(_docs_in(x["b"]), return_inverse=True)
            unseen = -np.frombuffer(x["c"], "<f4").astype(np.float64) * (n == 0)
            sums = [np.bincount(inverse, v, len(doc)) for v in (n > 0, np.log10((n + 0.5) / low), unseen)]
            yield _row(x["piece"], x["chunk"], 2, _docs_out(doc), np.stack(sums).astype("<f8").tobytes())


def _gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from the rows of their piece."""
    ids, facts = None, None

    def close() -> pa.RecordBatch:
        return pa.record_batch([ids, *(pa.array(x) for x in facts)], ["doc_id", *_FACTS])

    for batch in batches(it):
        for x in batch.to_pylist():
            if x["kind"] == 0:
                if ids is not None:
                    yield close()
                ids = pa.ipc.open_stream(x["a"]).read_next_batch().column(0)
                facts = np.frombuffer(x["b"], "<f8").reshape(len(_FACTS), -1).copy()
            else:
                doc = _docs_in(x["a"])
                if x["kind"] == 1:
                    facts[4, doc] += np.frombuffer(x["b"], "<f4")
                else:
                    sums = np.frombuffer(x["b"], "<f8").reshape(3, -1)
                    for row, v in zip((2, 3, 5), sums):
                        facts[row, doc] += v
    if ids is not None:
        yield close()
