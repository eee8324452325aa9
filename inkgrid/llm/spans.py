"""Words of many texts as spans of one byte buffer, and hashes of spans without a Python loop over words.

CRC-32 is linear: a byte adds a term that depends on its value and its distance from the end, and the length adds a
constant. A span's checksum is the exclusive or of table entries over its bytes; a span above ``BLOCK`` bytes is cut
into blocks, folded one after another (four bytes of state moved by a block are bytes at the table's far distances).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of a span that the table covers at once.
BLOCK = 64
#: Bytes of text, and bytes of spans, worked on at once.
PIECE, SLICE = 1 << 21, 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_DIGIT, _UPPER, _LOWER = ((_BYTES >= a) & (_BYTES <= b) for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)))
#: A byte of a word as it is kept (A-Z lowered), 0 for a byte between words.
WORD_BYTE = np.where(_UPPER, _BYTES + 32, np.where(_DIGIT | _LOWER | (_BYTES >= 0x80), _BYTES, 0)).astype(np.uint8)


@dataclass(frozen=True)
class Words:
    """Words of some texts: ``buffer`` holds them with one byte after each, a space; ``row`` is the text's place."""

    buffer: np.ndarray
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    #: The first word was the last one of the piece before and stands here for its neighbour's sake.
    carried: bool

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def fresh(self) -> slice:
        """The words not counted in the piece before."""
        return slice(1 if self.carried else 0, None)

    def pairs(self) -> np.ndarray:
        """Places of words whose next word stands in the same text."""
        return np.nonzero(self.row[1:] == self.row[:-1])[0]


def _cut(kept: np.ndarray, row: np.ndarray, carried: bool) -> Words:
    """``kept``: bytes as in WORD_BYTE, ending with 0; ``row``: for each text its end in ``kept`` and its place."""
    inside = kept != 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    inside[last] = True
    buffer = kept[inside]
    buffer[buffer == 0] = 32
    length = last - first
    start = np.cumsum(length + 1) - length - 1
    return Words(buffer, start, length, row[1][np.searchsorted(row[0], first, "right")], carried)


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[Words]:
    """Words of ``texts`` in runs of about ``most`` bytes; a longer text is cut between words, a long word never."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > most:
            yield from _long(texts[i], i, most)
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j]) + 1
            j += 1
        kept = WORD_BYTE[np.frombuffer(b"\0".join(texts[i:j]) + b"\0", np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield _cut(kept, (ends, np.arange(i, j)), False)
        i = j


def _long(text: bytes, row: int, most: int) -> Iterator[Words]:
    raw, at, carried = np.frombuffer(text, np.uint8), 0, False
    while at < len(raw):
        end, step = min(at + most, len(raw)), most
        while True:
            kept = WORD_BYTE[raw[at:end]]
            if end == len(raw):
                break
            # the last word that ends inside this piece, and where it begins
            gaps = np.nonzero(kept == 0)[0]
            if len(gaps) and gaps[0] < len(kept) - 1 and (words := np.nonzero(np.diff(kept.astype(bool).astype(np.int8)) == -1)[0]).size and words[-1] > 0:
                stop = int(words[-1]) + 1
                begin = stop - int(np.argmax(kept[:stop][::-1] == 0)) if (kept[:stop] == 0).any() else 0
                if begin > 0:
                    break
            elif not kept.any():
                stop = begin = len(kept)
                break
            step *= 2
            end = min(end + step, len(raw))
        done = end == len(raw)
        body = kept if done else kept[:stop]
        yield _cut(np.append(body, np.uint8(0)), (np.array([len(body) + 1]), np.array([row])), carried)
        if done:
            return
        carried = begin < stop
        at += begin


# -- CRC-32 --------------------------------------------------------------------------------------


def _zeros(n: int) -> int:
    return zlib.crc32(bytes(n))


def _terms() -> np.ndarray:
    """Entry 256 * d + b: what byte b adds when d bytes follow it."""
    rows = []
    for d in range(BLOCK):
        ground = _zeros(d + 1)
        rows.append([zlib.crc32(bytes([b]) + bytes(d)) ^ ground for b in range(256)])
    return np.array(rows, np.uint32).ravel()


TERMS = _terms()
_CONSTANT = np.array([_zeros(n) for n in range(BLOCK + 1)], np.uint32)


def _linear(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Exclusive or of the terms of each span of 1 to BLOCK bytes."""
    out = np.empty(len(start), np.uint32)
    ends = np.cumsum(length)
    lo = 0
    while lo < len(start):
        base = ends[lo] - length[lo]
        hi = max(int(np.searchsorted(ends, base + SLICE, "right")), lo + 1)
        n, stop = length[lo:hi].astype(np.int32), (ends[lo:hi] - base).astype(np.int32)
        step = np.arange(stop[-1], dtype=np.int32)
        at = step + np.repeat((start[lo:hi] - (stop - n)).astype(np.int32), n)
        term = (np.repeat(stop, n) - 1 - step) << 8
        term += buffer[at]
        out[lo:hi] = np.bitwise_xor.reduceat(TERMS[term], stop - n)
        lo = hi
    return out


def _past_block(state: np.ndarray) -> np.ndarray:
    """A state after one more block of zero bytes."""
    out = np.zeros(len(state), np.uint32)
    for k in range(4):
        out ^= TERMS[((BLOCK - 1 - k) << 8) + ((state >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    return out


def crc32_spans(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 (as zlib's) of each span of one byte or more."""
    out = np.empty(len(start), np.uint32)
    short = length <= BLOCK
    n = length[short]
    out[short] = _linear(buffer, start[short], n) ^ _CONSTANT[n]
    long = np.nonzero(~short)[0]
    long = long[np.argsort(-length[long], kind="stable")]
    for lo in range(0, len(long), 4096):
        here = long[lo : lo + 4096]
        n = length[here]
        blocks = -(-n // BLOCK)
        head = n - (blocks - 1) * BLOCK
        first = np.cumsum(blocks) - blocks
        k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        begin = np.repeat(start[here], blocks) + np.where(k == 0, 0, np.repeat(head, blocks) + (k - 1) * BLOCK)
        terms = _linear(buffer, begin, np.where(k == 0, np.repeat(head, blocks), BLOCK))
        state = terms[first]
        for step in range(1, int(blocks[0])):
            many = int(np.searchsorted(-blocks, -step, "left"))  # spans with more than ``step`` blocks come first
            state[:many] = _past_block(state[:many]) ^ terms[first[:many] + step]
        sizes, place = np.unique(n, return_inverse=True)
        out[here] = state ^ np.array([_zeros(int(x)) for x in sizes], np.uint32)[place]
    return out
