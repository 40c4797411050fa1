"""Lossless WebP (VP8L) of 32-bit pixel arrays: a decoder that reads many images in step, and encoders.

The decoder handles what the format has: canonical prefix codes (simple and normal, with groups chosen by an entropy
image), back-references with the two-dimensional distance map, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. Images that are decoded together advance pixel by pixel as the lanes of NumPy
arrays, so that a task's cost is a few array operations for each pixel position and not a Python step for each pixel.

Pixels are uint32 ARGB values.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

_U32, _U64 = np.uint32, np.uint64
BITS = 15  # longest prefix code
#: Fixed values of the format: order of the code length codes, multiplier of the colour cache, symbols of the alphabets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The 120 near pixels of the distance map: up to 8 to the side and 7 up, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR_X, _NEAR_Y = (np.array([p[k] for p in NEAR]) for k in (0, 1))


# ---------------------------------------------------------------- bits and codes


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if not n:
            return 0
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 8], "little")
        out = word >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes of code lengths, reversed as the stream holds them."""
    out, code = [0] * len(lengths), 0
    for n in range(1, BITS + 1):
        for s, m in enumerate(lengths):
            if m == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


def table(lengths: list[int]) -> np.ndarray:
    """For every 15 bits of stream the symbol shifted by four and the code's length; one symbol alone takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    out = np.zeros(1 << BITS, np.uint32)
    if len(used) <= 1:
        out[:] = (used[0] if used else 0) << 4
        return out
    if sum(1 << (BITS - lengths[s]) for s in used) != 1 << BITS:
        raise ValueError("prefix code is not complete")
    for s, code in zip(used, (codes(lengths)[s] for s in used), strict=True):
        out[code :: 1 << lengths[s]] = s << 4 | lengths[s]
    return out


def code_lengths(counts: dict[int, int], size: int, most: int = BITS) -> list[int]:
    """Huffman code lengths of at most ``most`` bits: while a code is longer, small counts are raised."""
    used = {s: c for s, c in counts.items() if c}
    out = [0] * size
    if len(used) <= 1:
        for s in used:
            out[s] = 1
        return out
    least = 1
    while True:
        heap = [(max(c, least), s, (s,)) for s, c in sorted(used.items())]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, k, y = heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (a + b, k, x + y))
        if max(depth.values()) <= most:
            break
        least *= 2
    for s, n in depth.items():
        out[s] = n
    return out


def write_code(w: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        wide = used[0] > 1
        w.write(int(wide), 1)
        w.write(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.write(used[1], 8)
        return
    w.write(0, 1)
    marks: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    i = 0
    while i < len(lengths):
        n = lengths[i]
        run = 1
        while i + run < len(lengths) and lengths[i + run] == n:
            run += 1
        i += run
        if n:
            marks.append((n, 0, 0))
            run -= 1
        while n and run >= 3:
            k = min(run, 6)
            marks.append((16, k - 3, 2))
            run -= k
        while not n and run >= 3:
            k = min(run, 138)
            marks.append((17, k - 3, 3) if k < 11 else (18, k - 11, 7))
            run -= k
        marks += [(n, 0, 0)] * run
    of = code_lengths(Counter(m[0] for m in marks), 19, 7)
    if sum(map(bool, of)) == 1:  # the reader wants a complete code of these
        of[next(s for s in range(19) if not of[s])] = 1
    last = max(k for k, s in enumerate(LENGTH_ORDER) if of[s])
    w.write(max(last + 1, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(last + 1, 4)]:
        w.write(of[s], 3)
    w.write(0, 1)
    c = codes(of)
    for s, extra, bits in marks:
        w.write(c[s], of[s])
        w.write(extra, bits)


def read_code(r: BitReader, size: int) -> list[int]:
    out = [0] * size
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        out[r.read(8 if wide else 1)] = 1
        if two:
            out[r.read(8)] = 1
        return out
    of = [0] * 19
    for s in LENGTH_ORDER[: 4 + r.read(4)]:
        of[s] = r.read(3)
    most = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    look = table(of)
    i, before = 0, 8
    while i < size and most:
        most -= 1
        e = int(look[int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 4], "little") >> (r.at & 7) & ((1 << BITS) - 1)])
        r.at += e & 15
        s = e >> 4
        if s < 16:
            out[i] = s
            i, before = i + 1, s or before
        else:
            n, run = (before, 3 + r.read(2)) if s == 16 else (0, 3 + r.read(3)) if s == 17 else (0, 11 + r.read(7))
            out[i : i + run] = [n] * run
            i += run
    return out[:size]


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra value, extra bits) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


# ---------------------------------------------------------------- headers


@dataclass
class Header:
    """What stands before the pixels: transforms, colour cache, code groups, and the bit where pixels begin."""

    width: int  # of the coded pixels
    height: int
    transforms: list[tuple] = field(default_factory=list)
    cache_bits: int = 0
    tables: np.ndarray | None = None  # groups x 5 x 2**15
    group: np.ndarray | None = None  # of each block
    group_bits: int = 0
    at: int = 0


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_image(r: BitReader, width: int, height: int, main: bool) -> Header:
    h = Header(width, height)
    if r.read(1):
        h.cache_bits = r.read(4)
        if not 1 <= h.cache_bits <= 11:
            raise ValueError("size of the colour cache")
    groups = 1
    if main and r.read(1):
        h.group_bits = r.read(3) + 2
        part = _read_pixels(r, _blocks(width, h.group_bits), _blocks(height, h.group_bits))
        h.group = (part >> _U32(8) & _U32(0xFFFF)).astype(np.int64)
        groups = int(h.group.max()) + 1
    extra = 1 << h.cache_bits if h.cache_bits else 0
    sizes = (LITERALS + LENGTHS + extra, 256, 256, 256, DISTANCES)
    h.tables = np.stack([np.stack([table(read_code(r, n)) for n in sizes]) for _ in range(groups)])
    h.at = r.at
    return h


def _read_pixels(r: BitReader, width: int, height: int) -> np.ndarray:
    h = _read_image(r, width, height, False)
    out, ends = decode_lanes(r.data, [h], np.array([r.at]))
    r.at = int(ends[0])
    return out[0]


def read_header(data: bytes) -> tuple[int, int, Header]:
    """(width, height, header) of VP8L data."""
    r = BitReader(data)
    if r.read(8) != 0x2F:
        raise ValueError("not lossless WebP")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("version")
    transforms, w = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            transforms.append((kind, w, bits, _read_pixels(r, _blocks(w, bits), _blocks(height, bits))))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colours = np.cumsum(_read_pixels(r, n, 1).view(np.uint8).reshape(-1, 4), 0, dtype=np.uint8).copy().view(_U32).ravel()
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, bits, colours))
            w = _blocks(w, bits)
        else:
            transforms.append((kind, w))
    h = _read_image(r, w, height, True)
    h.transforms = transforms
    return width, height, h


# ---------------------------------------------------------------- pixels in step


def decode_lanes(data: bytes, headers: list[Header], at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Coded pixels of images that share one byte string, and the bits where they end. ``at``: where pixels begin."""
    count = np.array([h.width * h.height for h in headers])
    order = np.argsort(-count, kind="stable")
    count, at = count[order], at[order].astype(np.int64)
    headers = [headers[i] for i in order]
    first: dict[int, int] = {}
    stacks, rows = [], 0
    for h in headers:
        if id(h.tables) not in first:
            first[id(h.tables)] = rows
            stacks.append(h.tables.reshape(-1, 1 << BITS))
            rows += len(stacks[-1])
    look = np.concatenate(stacks).ravel() if stacks else np.zeros(0, np.uint32)
    base = np.array([first[id(h.tables)] for h in headers], np.int64) << BITS
    raw = np.frombuffer(data + bytes(12), np.uint8)
    out = np.zeros((len(headers), int(count[0]) if len(count) else 0), _U32)
    width = np.array([h.width for h in headers], np.int64)
    caches = np.array([h.cache_bits for h in headers], np.int64)
    cache = np.zeros((len(headers), 1 << int(caches.max(initial=0))), _U32) if caches.any() else None
    grouped = any(h.group is not None for h in headers)
    copy, back = np.zeros(len(headers), np.int64), np.zeros(len(headers), np.int64)
    lanes = np.arange(len(headers))
    low = (1 << BITS) - 1
    # unaligned 32-bit words at every byte
    words = raw[:-3].astype(_U32)
    for k in (1, 2, 3):
        words |= raw[k : len(raw) - 3 + k].astype(_U32) << _U32(8 * k)

    def peek(p: np.ndarray, n: int) -> np.ndarray:
        return words[p >> 3] >> (p & 7).astype(_U32) & _U32((1 << n) - 1)

    def symbol(p: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        e = look[b + (k << BITS) + (words[p >> 3] >> (p & 7).astype(_U32) & _U32(low))]
        return e >> _U32(4), p + (e & _U32(15))

    def value(p: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prefix = prefix.astype(np.int64)
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        more = peek(p, 25).astype(np.int64) & ((1 << extra) - 1)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), p + extra

    n = len(headers)
    for i in range(int(count[0]) if n else 0):
        while n and count[n - 1] <= i:
            n -= 1
        p, b = at[:n], base[:n]
        if grouped:
            b = b.copy()
            for k in range(n):
                h = headers[k]
                if h.group is not None:
                    y, x = divmod(i, h.width)
                    b[k] += h.group[(y >> h.group_bits) * _blocks(h.width, h.group_bits) + (x >> h.group_bits)] * 5 << BITS
        busy = copy[:n] > 0
        some = busy.any()
        live = np.flatnonzero(~busy) if some else lanes[:n]
        pl, bl = (p[live], b[live]) if some else (p, b)
        s, pl = symbol(pl, bl, 0)
        other = s >= LITERALS
        pixel = s << _U32(8)
        if other.any():
            plain = ~other
            lit, pp, bb = live[plain], pl[plain], bl[plain]
            red, pp = symbol(pp, bb, 1)
            blue, pp = symbol(pp, bb, 2)
            alpha, pp = symbol(pp, bb, 3)
            out[lit, i] = pixel[plain] | red << _U32(16) | blue | alpha << _U32(24)
            at[lit] = pp
            ref = other & (s < LITERALS + LENGTHS)
            if ref.any():
                who, pp = live[ref], pl[ref]
                length, pp = value(pp, s[ref] - _U32(LITERALS))
                d, pp = symbol(pp, bl[ref], 4)
                d, pp = value(pp, d)
                near = np.minimum(d, len(NEAR)) - 1
                d = np.where(d > len(NEAR), d - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[who]))
                copy[who], back[who], at[who] = length, d, pp
            kept = other & (s >= LITERALS + LENGTHS)
            if kept.any():
                who = live[kept]
                out[who, i] = cache[who, s[kept].astype(np.int64) - (LITERALS + LENGTHS)]
                at[who] = pl[kept]
        else:
            red, pl = symbol(pl, bl, 1)
            blue, pl = symbol(pl, bl, 2)
            alpha, pl = symbol(pl, bl, 3)
            out[live, i] = pixel | red << _U32(16) | blue | alpha << _U32(24)
            at[live] = pl
        if some or other.any():
            who = np.flatnonzero(copy[:n] > 0)
            out[who, i] = out[who, i - back[who]]
            copy[who] -= 1
        if cache is not None:
            who = np.flatnonzero(caches[:n] > 0)
            px = out[who, i]
            cache[who, (px * _U32(CACHE_HASH) >> (32 - caches[who]).astype(_U32)).astype(np.int64)] = px
    back_to = np.empty(len(order), np.int64)
    back_to[order] = np.arange(len(order))
    return [out[k, : count[k]] for k in back_to], at[back_to]


# ---------------------------------------------------------------- transforms


def _channels(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint8).reshape(*x.shape, 4).astype(np.int32)  # blue, green, red, alpha


def _pixels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((c & 255).astype(np.uint8)).view(_U32).reshape(c.shape[:-1])


def _predict(mode: int, left, top, right, corner) -> np.ndarray:
    """The predicted channels of one pixel from its neighbours."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int32)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode <= 10:
        return (
            lambda: mean(mean(left, right), top), lambda: mean(left, corner), lambda: mean(left, top), lambda: mean(corner, top),
            lambda: mean(top, right), lambda: mean(mean(left, corner), mean(top, right)),
        )[mode - 5]()
    if mode == 11:
        guess = left + top - corner
        return np.where(np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    half = mean(left, top)
    return np.clip(half + np.trunc((half - corner) / 2).astype(np.int32), 0, 255)


#: Prediction modes that don't look at the pixel to the left, so that a row of them is inverted at once.
_ABOVE = (0, 2, 3, 4, 8, 9)


def _modes(y: int, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    return modes[(y >> bits) * _blocks(width, bits) + (np.arange(width) >> bits)].astype(np.int64) >> 8 & 15


def _row_above(image: np.ndarray, y: int, of: np.ndarray) -> np.ndarray:
    """Predictions of row y where the modes ``of`` look at the row above alone (the left neighbours are taken as they stand)."""
    top, out = image[y - 1], np.zeros_like(image[y])
    left = np.concatenate([image[y, :1], image[y, :-1]])
    corner = np.concatenate([top[:1], top[:-1]])
    right = np.concatenate([top[1:], image[y, :1]])
    for mode in np.unique(of):
        out = np.where((of == mode)[:, None], _predict(int(mode), left, top, right, corner), out)
    out[0] = top[0]
    return out


def _predict_all(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Predictions of a known image."""
    out = np.zeros_like(image)
    out[0, 0] = (0, 0, 0, 255)
    out[0, 1:] = image[0, :-1]
    for y in range(1, len(image)):
        out[y] = _row_above(image, y, _modes(y, image.shape[1], modes, bits))
    return out


def _unpredict(image: np.ndarray, modes: np.ndarray, bits: int) -> None:
    """Add the predictions to the residuals, in place."""
    height, width = image.shape[:2]
    image[0, 0] = (image[0, 0] + (0, 0, 0, 255)) & 255
    image[0] = np.cumsum(image[0], 0) & 255
    for y in range(1, height):
        of = _modes(y, width, modes, bits)
        if np.isin(of[1:], _ABOVE).all():
            first = (image[y, 0] + image[y - 1, 0]) & 255
            image[y, 0] = first
            guess = _row_above(image, y, of)
            image[y, 1:] = (image[y, 1:] + guess[1:]) & 255
            continue
        for x in range(width):
            if x:
                right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
                guess = _predict(int(of[x]), image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1])
            else:
                guess = image[y - 1, 0]
            image[y, x] = (image[y, x] + guess) & 255


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(c: np.ndarray, codes_: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    h, w = c.shape[:2]
    at = (np.arange(h)[:, None] >> bits) * _blocks(w, bits) + (np.arange(w)[None] >> bits)
    m = codes_[at].astype(np.int64)
    to_red, to_blue, red_to_blue = _signed(m), _signed(m >> 8), _signed(m >> 16)
    green, c = _signed(c[..., 1]), c.copy()
    sign = -1 if forward else 1
    before = c[..., 2].copy()
    c[..., 2] = (c[..., 2] + sign * (to_red * green >> 5)) & 255
    red = before if forward else c[..., 2]
    c[..., 0] = (c[..., 0] + sign * ((to_blue * green >> 5) + (red_to_blue * _signed(red) >> 5))) & 255
    return c


def invert(pixels: np.ndarray, height: int, transforms: list[tuple]) -> np.ndarray:
    """Undo the transforms, the last one first; a flat array of pixels in and out."""
    for kind, width, *rest in reversed(transforms):
        if kind == PALETTE:
            bits, colours = rest
            each = 1 << bits
            packed = (pixels.reshape(height, -1) >> _U32(8) & _U32(255)).astype(np.int64)
            depth = 8 >> bits
            index = (packed[..., None] >> (np.arange(each) * depth) & ((1 << depth) - 1)).reshape(height, -1)[:, :width]
            pixels = np.where(index < len(colours), colours[np.minimum(index, len(colours) - 1)], 0).astype(_U32).ravel()
        elif kind == SUBTRACT_GREEN:
            c = _channels(pixels)
            c[..., 2] += c[..., 1]
            c[..., 0] += c[..., 1]
            pixels = _pixels(c)
        elif kind == CROSS_COLOUR:
            bits, codes_ = rest
            pixels = _pixels(_cross(_channels(pixels.reshape(height, width)), codes_, bits, False)).ravel()
        else:
            bits, modes = rest
            image = _channels(pixels.reshape(height, width))
            _unpredict(image, modes, bits)
            pixels = _pixels(image).ravel()
    return pixels


# ---------------------------------------------------------------- files


def riff(data: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def split_riff(media: bytes) -> list[bytes]:
    """VP8L data of the WebP files that stand one after another in ``media``."""
    out, at = [], 0
    while at < len(media):
        size, n = struct.unpack_from("<I", media, at + 4)[0], struct.unpack_from("<I", media, at + 16)[0]
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        out.append(media[at + 20 : at + 20 + n])
        at += 8 + size
    return out


def decode_images(images: list[bytes], known: list[tuple[bytes, int, Header]]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, flat pixels) of VP8L images. ``known`` keeps headers without blocks, for images that begin alike."""
    sizes, headers, starts = [], [], []
    offset = 0
    for data in images:
        fields = int.from_bytes(data[1:5], "little")
        width, height = (fields & 0x3FFF) + 1, (fields >> 14 & 0x3FFF) + 1
        for begin, last, h in known:
            n = len(begin)
            if data[0] == 0x2F and data[5 : 5 + n] == begin and data[5 + n] & ((1 << (h.at & 7)) - 1) == last:
                h = Header(width, height, h.transforms, h.cache_bits, h.tables, None, 0, h.at)
                break
        else:
            width, height, h = read_header(data)
            if not h.transforms and h.group is None and len(known) < 64:
                n = (h.at >> 3) - 5
                known.append((data[5 : 5 + n], data[5 + n] & ((1 << (h.at & 7)) - 1), h))
        sizes.append((width, height))
        headers.append(h)
        starts.append(8 * offset + h.at)
        offset += len(data)
    pixels, _ = decode_lanes(b"".join(images), headers, np.array(starts, np.int64))
    return [(w, h, invert(p, h, x.transforms)) for (w, h), x, p in zip(sizes, headers, pixels, strict=True)]


# ---------------------------------------------------------------- encoders


def _tokens(pixels: np.ndarray, width: int, cache_bits: int, references: bool) -> list[tuple]:
    """("literal", pixel), ("copy", length, distance) and ("cache", index) tokens: greedy, by the last place of three pixels."""
    px = pixels.tolist()
    out: list[tuple] = []
    cache: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    i = 0
    slot = lambda p: (p * CACHE_HASH & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        length = 0
        if references and i + 2 < len(px) and (j := seen.get(tuple(px[i : i + 3]))) is not None:
            while i + length < len(px) and length < 4096 and px[j + length] == px[i + length]:
                length += 1
        if length:
            out.append(("copy", length, i - j))
        elif cache_bits and cache.get(slot(px[i])) == px[i]:
            out.append(("cache", slot(px[i])))
        else:
            out.append(("literal", px[i]))
        for k in range(i, i + max(1, length)):
            if cache_bits:
                cache[slot(px[k])] = px[k]
            if k + 2 < len(px):
                seen[tuple(px[k : k + 3])] = k
        i += max(1, length)
    return out


def distance_code(distance: int, width: int) -> int:
    for k, (x, y) in enumerate(NEAR):
        if max(1, x + y * width) == distance:
            return k + 1
    return distance + len(NEAR)


def _write_pixels(w: BitWriter, pixels: np.ndarray, width: int, cache_bits: int, references: bool, main: bool, groups: tuple | None = None) -> None:
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    bits, of = groups if groups else (0, None)
    if main:
        w.write(int(bool(groups)), 1)
        if groups:
            w.write(bits - 2, 3)
            _write_pixels(w, (of.astype(_U32) << _U32(8)), _blocks(width, bits), 0, True, False)
    tokens = _tokens(pixels, width, cache_bits, references)
    n_groups = int(of.max()) + 1 if groups else 1
    counts = [[Counter() for _ in range(5)] for _ in range(n_groups)]
    marks: list[list[tuple[int, int, int, int, int]]] = []  # (group, code, symbol, extra, bits)
    i = 0
    for kind, *rest in tokens:
        y, x = divmod(i, width)
        g = int(of[(y >> bits) * _blocks(width, bits) + (x >> bits)]) if groups else 0
        if kind == "literal":
            p = rest[0]
            marks += [(g, 0, p >> 8 & 255, 0, 0), (g, 1, p >> 16 & 255, 0, 0), (g, 2, p & 255, 0, 0), (g, 3, p >> 24, 0, 0)]
            i += 1
        elif kind == "cache":
            marks.append((g, 0, LITERALS + LENGTHS + rest[0], 0, 0))
            i += 1
        else:
            s, extra, n = prefix_of(rest[0])
            marks.append((g, 0, LITERALS + s, extra, n))
            s, extra, n = prefix_of(distance_code(rest[1], width))
            marks.append((g, 4, s, extra, n))
            i += rest[0]
    for g, k, s, _, _ in marks:
        counts[g][k][s] += 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    lengths = [[code_lengths(c, n) for c, n in zip(five, sizes, strict=True)] for five in counts]
    for five in lengths:
        for x in five:
            write_code(w, x)
    made = [[codes(x) if sum(map(bool, x)) > 1 else [0] * len(x) for x in five] for five in lengths]
    for g, k, s, extra, n in marks:
        w.write(made[g][k][s], lengths[g][k][s] if sum(map(bool, lengths[g][k])) > 1 else 0)
        w.write(extra, n)


def encode(pixels: np.ndarray, width: int, transforms: tuple = (), cache_bits: int = 0, references: bool = True, groups: tuple | None = None) -> bytes:
    """VP8L data of a flat pixel array with codes of its own.

    ``transforms``: (PREDICTOR, bits, modes of blocks), (CROSS_COLOUR, bits, codes of blocks), (SUBTRACT_GREEN,) and
    (PALETTE,), in order. ``groups``: (bits, group of each block of the coded pixels).
    """
    height = len(pixels) // width
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    for kind, *rest in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        if kind == PALETTE:
            colours, index = np.unique(pixels, return_inverse=True)
            w.write(len(colours) - 1, 8)
            steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_pixels(w, np.ascontiguousarray(steps).view(_U32).ravel(), len(colours), 0, False, False)
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            new = _blocks(width, bits)
            rows = np.zeros((height, new << bits), np.int64)
            rows[:, :width] = index.reshape(height, width)
            packed = (rows.reshape(height, new, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))).sum(2)
            pixels, width = (packed.astype(_U32) << _U32(8) | _U32(0xFF000000)).ravel(), new
        elif kind == SUBTRACT_GREEN:
            c = _channels(pixels)
            c[..., 2] -= c[..., 1]
            c[..., 0] -= c[..., 1]
            pixels = _pixels(c)
        else:
            bits, blocks = rest
            w.write(bits - 2, 3)
            _write_pixels(w, blocks.astype(_U32), _blocks(width, bits), 0, False, False)
            image = _channels(pixels.reshape(height, width))
            if kind == CROSS_COLOUR:
                image = _cross(image, blocks, bits, True)
            else:
                image = (image - _predict_all(image, blocks, bits)) & 255
            pixels = _pixels(image).ravel()
    w.write(0, 1)
    _write_pixels(w, pixels, width, cache_bits, references, True, groups)
    return w.bytes()
