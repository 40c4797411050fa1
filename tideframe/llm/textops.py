"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow text columns.

All functions work on a flat byte array that holds many documents one after another, so that NumPy handles whole
batches. Words are ``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits, fixed by SEED, equal on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEED = 0x5DEECE66D
#: Bytes of text that are handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (xorshift and multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_ODD = mix(np.arange(1, 65, dtype=_U) + _U(SEED)) | _U(1)
BYTE_CODE = mix(np.arange(256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(SEED))
_R = int(_ODD[40]) & ~7 | 5
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def pair(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Ordered combination of two hash arrays; ``k`` names the combination."""
    return mix(a * _ODD[2 * k % 62] + (b ^ (b >> _U(29))) * _ODD[(2 * k + 1) % 62])


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = 1 << max(12, (n - 1).bit_length())
        have = np.ones(m, _U)
        step, size = base, 1
        while size < m:
            have[size : 2 * size] = have[:size] * _U(step)
            step, size = step * step % (1 << 64), 2 * size
        if m <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds (n + 1 offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte each starts at."""
    starts = np.flatnonzero((b & 0xC0) != 0x80)
    wide = np.r_[b, np.zeros(3, np.uint8)].astype(np.uint32)
    out = wide[starts]
    for lead, mask, n in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        long = starts[b[starts] >= lead]
        code = wide[long] & mask
        for k in range(1, n):
            code = code << 6 | (wide[long + k] & 0x3F)
        out[b[starts] >= lead] = code
    return out, starts


class Words:
    """Words of documents lo..hi-1: byte spans, 64-bit hashes, and the number in each document.

    ``inside`` marks the byte values that words are made of; without it words end at white space alone.
    """

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, lo: int, hi: int, inside: np.ndarray | None = None):
        self.base = int(bounds[lo])
        self.bytes = b = flat[bounds[lo] : bounds[hi]]
        edges = bounds[lo : hi + 1] - self.base
        self.edges = edges
        solid = np.zeros(len(b) + 1, bool)
        solid[:-1] = ((b != 32) & ((b - np.uint8(9)) > 4)) if inside is None else inside[b]
        first = solid[:-1].copy()
        first[1:] &= ~solid[:-2]
        last = solid[:-1] & ~solid[1:]
        inner = edges[(edges > 0) & (edges < len(b))]
        first[inner] |= solid[inner]
        last[inner - 1] |= solid[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        cut = np.searchsorted(self.starts, edges)
        self.first = cut[:-1]  # index of each document's first word
        self.counts = np.diff(cut)
        self._prefix: np.ndarray | None = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
        """Hashes of byte spans from prefix sums of a polynomial."""
        n = len(self.bytes)
        if self._prefix is None or self._code is not code:
            self._prefix = np.zeros(n + 1, _U)
            np.cumsum(code[self.bytes] * powers(_R, n), out=self._prefix[1:])
            self._code = code
        inverse = powers(_R_INV, n + 1)
        return mix((self._prefix[ends] - self._prefix[starts]) * inverse[starts] + (ends - starts).astype(_U) * _ODD[60])

    def hashes(self, code: np.ndarray = BYTE_CODE) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, code)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


#: Byte codes that give A-Z the codes of a-z: hashes of words lower-cased in ASCII alone.
LOWER_CODE = BYTE_CODE[[c + 32 if 65 <= c <= 90 else c for c in range(256)]]

#: Bytes of letters and digits: ASCII ones and all bytes of longer UTF-8 sequences.
LETTERS = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
