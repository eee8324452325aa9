"""Baseline JPEG in NumPy: entropy decoding symbol by symbol, all that follows for whole planes at once."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


class JpegError(ValueError):
    """Bytes that are no JPEG of a kind that is read here."""


@lru_cache(1)
def _zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient in the order of the file: diagonals, turned in alternation."""
    places = sorted(((y + x, (y if (y + x) % 2 else x), y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([p[2] for p in places])


def _fixed(x: float, bits: int = 13) -> int:
    return int(np.floor(x * (1 << bits) + 0.5))


@lru_cache(1)
def _turn() -> np.ndarray:
    """Eight samples from eight frequencies, in whole parts of 2^13: the sums of the factorised transform by Loeffler, Ligtenberg and Moschytz, in which only eleven factors are rounded."""
    angle = lambda k: np.cos(k * np.pi / 16) * np.sqrt(2)
    c1, c2, c3, c5, c6, c7 = map(angle, (1, 2, 3, 5, 6, 7))
    f = np.eye(8, dtype=np.int64)
    even = (f[2] + f[6]) * _fixed(c6)
    low, high = even - f[6] * _fixed(c2 + c6), even + f[2] * _fixed(c2 - c6)
    a, b = (f[0] + f[4]) << 13, (f[0] - f[4]) << 13
    left = (a + high, b + low, b - low, a - high)
    both = (f[7] + f[3] + f[5] + f[1]) * _fixed(c3)
    z1, z2 = (f[7] + f[1]) * -_fixed(c3 - c7), (f[5] + f[3]) * -_fixed(c1 + c3)
    z3, z4 = both - (f[7] + f[3]) * _fixed(c3 + c5), both - (f[5] + f[1]) * _fixed(c3 - c5)
    right = (
        f[1] * _fixed(c1 + c3 - c5 - c7) + z1 + z4, f[3] * _fixed(c1 + c3 + c5 - c7) + z2 + z3,
        f[5] * _fixed(c1 + c3 - c5 + c7) + z2 + z4, f[7] * _fixed(-c1 + c3 + c5 - c7) + z1 + z3,
    )
    return np.array([x + y for x, y in zip(left, right)] + [x - y for x, y in zip(left[::-1], right[::-1])])


def _descaled(x: np.ndarray, bits: int) -> np.ndarray:
    return (x + (1 << bits - 1)) >> bits


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    dc: int = 0
    ac: int = 0
    last: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits that may come next: length of the code * 256 + its symbol, 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    at, k = 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            if at + (1 << 16 - length) > 1 << 16:
                raise JpegError("a code table that is too full")
            out[at : at + (1 << 16 - length)] = length << 8 | symbol
            at += 1 << 16 - length
        k += n
    return out.tolist()


def _windows(data: bytes) -> list[int]:
    """The 32 bits from each byte on; ones follow the end."""
    b = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
    return (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]).tolist()


def _scan(data: bytes, first: int, count: int, units: list[tuple[Component, list[int]]], dc: dict, ac: dict) -> None:
    """Coefficients of ``count`` units from unit ``first`` on. ``units``: for each block of a unit its component and rule for its place."""
    windows, at, end = _windows(data), 0, 8 * len(data)
    for unit in range(first, first + count):
        for part, place in units:
            block = place(unit)
            out, table = part.blocks, dc[part.dc]
            if at > end:
                raise JpegError("the picture ends early")
            code = table[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]
            if not code:
                raise JpegError("a code that is not in its table")
            at += code >> 8
            size = code & 255
            if size:
                value = windows[at >> 3] >> 32 - (at & 7) - size & (1 << size) - 1
                at += size
                part.last += value if value >> size - 1 else value - (1 << size) + 1
            out[block] = part.last
            table, k = ac[part.ac], 1
            while k < 64:
                code = table[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]
                if not code:
                    raise JpegError("a code that is not in its table")
                at += code >> 8
                size = code & 15
                if size:
                    k += code >> 4 & 15
                    if k > 63:
                        raise JpegError("too many coefficients in a block")
                    value = windows[at >> 3] >> 32 - (at & 7) - size & (1 << size) - 1
                    at += size
                    out[block + k] = value if value >> size - 1 else value - (1 << size) + 1
                    k += 1
                elif code & 0xF0 == 0xF0:
                    k += 16
                else:
                    break
    if at > end + 7:
        raise JpegError("the picture ends early")


def _plane(part: Component, rows: int, columns: int, steps: np.ndarray) -> np.ndarray:
    """Samples of a component of so many blocks."""
    x = np.zeros((rows * columns, 64), np.int64)
    x[:, _zigzag()] = part.blocks.reshape(-1, 64).astype(np.int64) * steps
    # sums stay far below 2^53, where doubles are exact
    turn = _turn().astype(np.float64)
    x = _descaled((turn @ x.reshape(-1, 8, 8).astype(np.float64)).astype(np.int64), 11)
    x = _descaled((x.astype(np.float64) @ turn.T).astype(np.int64), 18)
    x = x.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
    return np.clip(x + 128, 0, 255).astype(np.int32)


def _doubled(a: np.ndarray, one: int, two: int, shift: int) -> np.ndarray:
    """Twice as many rows, three parts of the near and one of the far neighbour; the outermost are repeated."""
    out = np.empty((2 * a.shape[0], a.shape[1]), np.int32)
    out[0::2], out[1::2] = (3 * a + np.concatenate([a[:1], a[:-1]]) + one) >> shift, (3 * a + np.concatenate([a[1:], a[-1:]]) + two) >> shift
    return out


def _enlarged(a: np.ndarray, across: int, down: int) -> np.ndarray:
    """A plane at the picture's resolution: smooth for halves, repeated for other parts and for very narrow planes."""
    if (across, down) == (1, 2):
        return _doubled(a, 1, 2, 2)
    if (across, down) == (2, 1) and a.shape[1] > 2:
        return _doubled(a.T, 1, 2, 2).T
    if (across, down) == (2, 2) and a.shape[1] > 2:
        return _doubled(_doubled(a, 0, 0, 0).T, 8, 7, 4).T
    return np.repeat(np.repeat(a, down, 0), across, 1)


def _segments(data: bytes):
    """(marker, body, place after it) of each segment up to the first scan's header."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("no marker where one must be")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        if size < 2 or at + 2 + size > len(data):
            raise JpegError("a segment beyond the end")
        yield mark, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Coded bytes of a scan, cut at its restart markers, and where the next marker stands."""
    parts, start, look = [], at, at
    while True:
        look = data.find(b"\xff", look)
        if look < 0 or look + 1 >= len(data):
            parts.append(data[start:])
            look = len(data)
            break
        mark = data[look + 1]
        if mark == 0 or mark == 0xFF:
            look += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            parts.append(data[start:look])
            start = look = look + 2
        else:
            parts.append(data[start:look])
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in parts], look


def decode_jpeg(data: bytes) -> np.ndarray:
    """H x W (gray) or H x W x 3 (RGB) of a baseline or extended sequential JPEG with 8 bits and Huffman codes."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    steps: dict[int, np.ndarray] = {}
    dc: dict[int, list[int]] = {}
    ac: dict[int, list[int]] = {}
    parts: list[Component] = []
    height = width = restart = 0
    plain = None
    done = 0
    try:
        segments = _segments(data)
        while (found := next(segments, None)) is not None:
            mark, body, after = found
            if mark == 0xDB:
                while body:
                    wide, number = body[0] >> 4, body[0] & 15
                    n = 128 if wide else 64
                    steps[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[1 + n :]
            elif mark == 0xC4:
                while body:
                    kind, number, counts = body[0] >> 4, body[0] & 15, body[1:17]
                    n = sum(counts)
                    (ac if kind else dc)[number] = _lookup(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1):
                depth, height, width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or n not in (1, 3) or not height or not width:
                    raise JpegError("a JPEG of an unknown kind")
                parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if any(not 1 <= x <= 4 for p in parts for x in (p.across, p.down)):
                    raise JpegError("a JPEG of an unknown kind")
                wide, tall = max(p.across for p in parts), max(p.down for p in parts)
                units = -(-height // (8 * tall)), -(-width // (8 * wide))
                for p in parts:
                    p.blocks = np.zeros(units[0] * p.down * units[1] * p.across * 64, np.int32)
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise JpegError("a progressive or otherwise coded JPEG")
            elif mark == 0xDD:
                (restart,) = struct.unpack(">H", body[:2])
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                plain = body[11] == 0
            elif mark == 0xDA:
                if not parts:
                    raise JpegError("a scan before its frame")
                chosen = []
                for i in range(body[0]):
                    part = next(p for p in parts if p.number == body[1 + 2 * i])
                    part.dc, part.ac, part.last = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15, 0
                    chosen.append(part)
                after = _read_scan(data, after, chosen, units, (height, width, tall, wide), restart, dc, ac)
                done += len(chosen)
                if done >= len(parts):
                    break
                data = b"\xff\xd8" + data[after:]  # tables and scans that follow
                segments = _segments(data)
        if not parts or done < len(parts):
            raise JpegError("a JPEG without its picture")
        planes = []
        for p in parts:
            a = _plane(p, units[0] * p.down, units[1] * p.across, steps[p.table])
            # samples beyond the picture don't count as neighbours
            a = a[: -(-height * p.down // tall), : -(-width * p.across // wide)]
            planes.append(_enlarged(a, wide // p.across, tall // p.down)[:height, :width])
    except (struct.error, IndexError, KeyError, StopIteration, ValueError) as e:
        raise e if isinstance(e, JpegError) else JpegError(f"a broken JPEG: {type(e).__name__}") from e
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    if plain or (plain is None and [p.number for p in parts] == list(b"RGB")):
        return np.dstack(planes).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    red, blue, green = (_fixed(f, 16) for f in (1.402, 1.772, 0.34414))
    green = -green * cb - _fixed(0.71414, 16) * cr
    rgb = np.stack([y + _descaled(red * cr, 16), y + _descaled(green, 16), y + _descaled(blue * cb, 16)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def _read_scan(data: bytes, at: int, chosen: list[Component], units: tuple[int, int], size: tuple[int, int, int, int], restart: int, dc: dict, ac: dict) -> int:
    height, width, tall, wide = size
    if len(chosen) > 1:
        total = units[0] * units[1]

        def place(p: Component, dy: int, dx: int):
            row = units[1] * p.across
            return lambda u: ((u // units[1] * p.down + dy) * row + u % units[1] * p.across + dx) * 64

        blocks = [(p, place(p, dy, dx)) for p in chosen for dy in range(p.down) for dx in range(p.across)]
    else:  # a component alone is coded block by block, those beyond the picture left out
        p = chosen[0]
        row, columns = units[1] * p.across, -(-(-(-width * p.across // wide)) // 8)
        total = -(-(-(-height * p.down // tall)) // 8) * columns
        blocks = [(p, lambda u: (u // columns * row + u % columns) * 64)]
    parts, after = _intervals(data, at)
    step = restart or total
    for i, first in enumerate(range(0, total, step)):
        if i >= len(parts):
            raise JpegError("the picture ends early")
        for p in chosen:
            p.last = 0
        _scan(parts[i], first, min(step, total - first), blocks, dc, ac)
    return after
