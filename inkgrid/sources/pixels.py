"""Decoding and colour normalisation of single images, in NumPy."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from .jpeg import JpegError, decode_jpeg


class LoadError(ValueError):
    """An input that is no image of a known kind."""


def encode_png(a: np.ndarray) -> bytes:
    """8-bit PNG of an array H x W (gray) or H x W x 2 (gray, alpha), 3 (RGB) or 4 (RGBA)."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    raw = b"".join(b"\0" + row.tobytes() for row in a.reshape(h, -1))

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG that is not interlaced: H x W or H x W x channels, 8 bits (1-bit images become 0 and 255)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise LoadError("not a PNG")
    at, idat, head, palette, clear = 8, [], None, None, b""
    while at + 8 <= len(data):
        (size,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            idat.append(body)
        at += 12 + size
    if head is None or not idat:
        raise LoadError("a PNG without a header or pixels")
    w, h, depth, kind, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or interlaced or depth not in (1, 2, 4, 8, 16):
        raise LoadError("a PNG of an unknown kind")
    line, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, line + 1)
    except (zlib.error, ValueError) as e:
        raise LoadError(f"a broken PNG: {e}") from e
    out = _unfiltered(raw, step)
    if depth == 16:
        out = out[:, 0::2]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)[:, :w]
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)
        out = (values if kind == 3 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out = out[:, : w * channels].reshape(h, w, channels)
    if kind == 3:
        if palette is None:
            raise LoadError("a PNG without its palette")
        index = out[:, :, 0]
        out = palette[index]
        if clear:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            out = np.dstack([out, alpha[index]])
    return out[:, :, 0] if out.shape[2] == 1 else out


def decode_picture(data: bytes) -> np.ndarray:
    """Pixels of a PNG or a baseline JPEG, told apart by their first bytes."""
    if data[:2] == b"\xff\xd8":
        try:
            return decode_jpeg(data)
        except JpegError as e:
            raise LoadError(str(e)) from e
    if data[:4] != b"\x89PNG":
        raise LoadError("neither PNG nor JPEG")
    return decode_png(data)


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    h, n = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h, n), np.uint8)
    above = np.zeros(n, np.int32)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 1:
            pad = -(-n // step) * step
            full = np.zeros(pad, np.int32)
            full[:n] = row
            row = (np.cumsum(full.reshape(-1, step), axis=0) & 255).ravel()[:n]
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            for x in range(n):
                a, b = (row[x - step] if x >= step else 0), above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x - step] if x >= step else 0
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                row[x] = (row[x] + guess) & 255
        out[y] = row
        above = row
    return out


def exif_orientation(data: bytes) -> int:
    """Orientation 1 to 8 of a JPEG's or PNG's EXIF block, 1 if there is none or it is broken."""
    try:
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    return _orientation(data[at + 10 : at + 2 + size])
                if mark == 0xDA:
                    break
                at += 2 + size
        elif data[:4] == b"\x89PNG":
            at = data.find(b"eXIf")
            if at > 0:
                size = struct.unpack(">I", data[at - 4 : at])[0]
                return _orientation(data[at + 4 : at + 4 + size])
    except (struct.error, IndexError):
        pass
    return 1


def _orientation(tiff: bytes) -> int:
    e = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(e + "I", tiff[4:8])[0]
    for i in range(struct.unpack(e + "H", tiff[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(e + "HHIH", tiff[at + 2 + 12 * i : at + 12 + 12 * i])
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as the orientation says they are to be seen."""
    if orientation in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return np.ascontiguousarray(a)


def half_turn(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a[::-1, ::-1])


def gray_alpha_to_bgr(a: np.ndarray) -> np.ndarray:
    """Gray where anything shows, plus the complement of alpha, at most 255."""
    gray, alpha = a[:, :, 0].astype(np.int32), a[:, :, 1].astype(np.int32)
    out = np.minimum(255, np.where(alpha > 0, gray, 0) + 255 - alpha).astype(np.uint8)
    return np.dstack([out] * 3)


def background(rgba: np.ndarray) -> int:
    """255 (white) for dark or no visible pixels, else 0 (black)."""
    shown = rgba[:, :, 3] > 0
    if not shown.any():
        return 255
    light = rgba[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    return 255 if light[shown].mean() < 128 else 0


def rgba_to_bgr(a: np.ndarray) -> np.ndarray:
    """Blended onto the background that sets it off."""
    ground = background(a)
    share = a[:, :, 3:4].astype(np.float32) / np.float32(255)
    return (a[:, :, 2::-1].astype(np.float32) * share + np.float32(ground) * (1 - share)).astype(np.uint8)


def to_bgr(a: np.ndarray, rgb: bool = True) -> np.ndarray:
    """H x W x 3 BGR of any pixels; ``rgb``: three channels come as RGB (decoded files), else they are BGR already."""
    if a.ndim == 2:
        return np.dstack([a] * 3)
    if a.ndim != 3:
        raise LoadError(f"an array of {a.ndim} dimensions")
    n = a.shape[2]
    if n == 1:
        return np.dstack([a[:, :, 0]] * 3)
    if n == 2:
        return gray_alpha_to_bgr(a)
    if n == 3:
        return np.ascontiguousarray(a[:, :, ::-1]) if rgb else a
    if n == 4:
        return rgba_to_bgr(a)
    raise LoadError(f"{n} channels")


#: Weights of the two neighbours are whole parts of this; rows of a result made at once.
WHOLE, ROWS = 2048, 32


@lru_cache(256)
def _neighbours(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each new place, the two old places around it and their weights (pixel centres aligned, edges repeated)."""
    at = (np.arange(new) + 0.5) * old / new - 0.5
    low = np.floor(at).astype(np.intp)
    share = np.rint((at - low) * WHOLE).astype(np.int32)
    first, second = np.clip(low, 0, old - 1), np.clip(low + 1, 0, old - 1)
    share[low < 0] = 0
    return first, second, WHOLE - share, share


def _runs(a: np.ndarray) -> np.ndarray:
    """Rows that repeat the one above have its number."""
    return np.concatenate([[0], np.cumsum((a[1:] != a[:-1]).any(1))])


def _resized(a: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The different rows of the result and which of them each row is (None: they are all rows)."""
    if (h, w) == a.shape[:2]:
        return a, None
    x0, x1, wx0, wx1 = _neighbours(a.shape[1], w)
    y0, y1, wy0, wy1 = _neighbours(a.shape[0], h)
    p = a.reshape(*a.shape[:2], -1)
    run = _runs(p.reshape(len(p), -1))
    y0, y1 = run[y0], run[y1]
    # between two equal rows the weights make no difference: such rows of the result are made once
    key = np.stack([y0, y1, np.where(y0 == y1, 0, wy1)])
    first = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
    y0, y1, wy0, wy1 = y0[first], y1[first], wy0[first], wy1[first]
    used = np.unique(np.concatenate([y0, y1]))  # a smaller result does not need all rows
    source = np.searchsorted(run, used)[:, None]
    rows = p[source, x0].astype(np.int32)
    rows *= wx0[:, None]
    rows += p[source, x1] * wx1[:, None]
    rows = rows.reshape(len(used), -1)
    y0, y1 = np.searchsorted(used, y0), np.searchsorted(used, y1)
    out = np.empty((len(y0), rows.shape[1]), np.uint8)
    for i in range(0, len(out), ROWS):
        part = slice(i, i + ROWS)
        top, low = rows[y0[part]], rows[y1[part]]
        top *= wy0[part, None]
        low *= wy1[part, None]
        top += low
        top += WHOLE * WHOLE // 2
        top >>= 22  # by WHOLE * WHOLE
        out[part] = top
    return out.reshape(len(out), w, *a.shape[2:]), None if first.all() else np.cumsum(first) - 1


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear in whole numbers, first along the rows, then along the columns; weights are kept by size."""
    rows, which = _resized(a, h, w)
    return rows if which is None else rows.take(which, 0)


def resized_planes(a: np.ndarray, h: int, w: int, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """``planes`` of ``resize``."""
    rows, which = _resized(a, h, w)
    out = planes(rows, mean, std)
    return out if which is None else out.take(which, 2)


def planes(a: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """Channels first, (value / 255 - mean) / std of each channel, with a batch dimension; every value is looked up."""
    out = np.empty((1, a.shape[2], *a.shape[:2]), np.float32)
    steps = np.arange(256, dtype=np.float32) / 255
    for c in range(a.shape[2]):
        np.take(((steps - np.float32(mean[c])) / np.float32(std[c])).astype(np.float32), a[:, :, c], out=out[0, c], mode="clip")
    return out


def normalize(a: np.ndarray, mean: float = 0.5, std: float = 0.5) -> np.ndarray:
    """Channels first, (value / 255 - mean) / std, with a batch dimension."""
    return ((a.astype(np.float32) / 255 - mean) / std).transpose(2, 0, 1)[None]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """3 x 3 matrix that takes four points to four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def project(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ m.T
    return p[:, :2] / p[:, 2:]


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at offset t (a = -0.75)."""
    a = -0.75
    d = np.stack([t + 1, t, 1 - t, 2 - t])
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    far = ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.where(d <= 1, near, far)


def straighten(a: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The crop of a quadrilateral as a rectangle (bicubic, edge pixels repeated), turned left if at least half as high again as wide."""
    box = np.asarray(box, float)
    side = lambda i, j: float(np.linalg.norm(box[i] - box[j]))
    w, h = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if w < 1 or h < 1:
        raise LoadError("a box without area")
    (x0, y0), (x1, y1) = box[0].tolist(), box[2].tolist()
    if box.tolist() == [[x0, y0], [x1, y0], [x1, y1], [x0, y1]] and 0 <= x0 < x1 <= a.shape[1] and 0 <= y0 < y1 <= a.shape[0] and all(v.is_integer() for v in (x0, y0, x1, y1)):
        crop = np.ascontiguousarray(a[int(y0) : int(y1), int(x0) : int(x1)])  # along the axes, on whole pixels: these are the crop
        return np.ascontiguousarray(np.rot90(crop)) if h / w >= 1.5 else crop
    back = homography(np.array([[0, 0], [w, 0], [w, h], [0, h]], float), box)
    y, x = np.mgrid[0:h, 0:w]
    at = project(back, np.c_[x.ravel(), y.ravel()])
    x0, y0 = np.floor(at[:, 0]).astype(int), np.floor(at[:, 1]).astype(int)
    wx, wy = _cubic(at[:, 0] - x0), _cubic(at[:, 1] - y0)
    out = np.zeros((h * w, a.shape[2]))
    for i in range(4):
        yy = np.clip(y0 - 1 + i, 0, a.shape[0] - 1)
        for j in range(4):
            out += a[yy, np.clip(x0 - 1 + j, 0, a.shape[1] - 1)] * (wy[i] * wx[j])[:, None]
    crop = np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(h, w, -1)
    return np.ascontiguousarray(np.rot90(crop)) if h / w >= 1.5 else crop


def padded(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled to ``height`` (at most ``width`` wide), values from -1 to 1, zeros to the right; channels first."""
    w = min(int(np.ceil(height * a.shape[1] / a.shape[0])), width)
    x = (resize(a, height, w).astype(np.float32).transpose(2, 0, 1) / 255 - 0.5) / 0.5
    out = np.zeros((a.shape[2], height, width), np.float32)
    out[:, :, :w] = x
    return out


def clockwise_quad(box: np.ndarray) -> np.ndarray:
    """Corners clockwise from the top left, for any quadrilateral: by angle about the centre, from the corner with the smallest x + y (the higher on ties)."""
    box = np.asarray(box, float)
    c = box - box.mean(0)
    order = np.argsort(np.arctan2(c[:, 1], c[:, 0]), kind="stable")
    box = box[order]
    first = min(range(4), key=lambda i: (round(box[i].sum(), 9), box[i][1]))
    return np.roll(box, -first, 0)


def words_on_page(box: np.ndarray, cells: list[np.ndarray], vertical: bool) -> list[np.ndarray]:
    """Word boxes of a straightened crop, in the page's coordinates."""
    box = np.asarray(box, float)
    low = np.floor(box.min(0))
    quad = box - low
    w, h = int(np.linalg.norm(quad[0] - quad[1])), int(np.linalg.norm(quad[0] - quad[3]))
    back = homography(np.array([[0, 0], [w, 0], [w, h], [0, h]], float), quad)
    out = []
    for cell in cells:
        p = np.asarray(cell, float)
        if vertical:  # the crop was turned left: turn back
            p = np.c_[w - p[:, 1], p[:, 0]]
        out.append(clockwise_quad(np.trunc(project(back, p) + low)))
    return out
