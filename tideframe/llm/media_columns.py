"""Media columns: texts as losslessly compressed WebP images, written to a table and decoded again.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of ROW, are rows of 144 ARGB pixels. Every TILE rows
are one image; a document's media is its WebP files one after another, so the decoder advances many images of like size
in step. Most are written with one fixed set of prefix codes (from the letter order below, so that equal texts have equal
files) and back-references for runs of equal pixels. An image that repeats its pixels is also written with codes of its own
and, as its pixels suggest, colour cache and references, palette, predictor, subtract-green and cross-colour; the smallest
file is kept. The decoder is the general one of ``webp_lossless``; ``media_pixels`` gives its pixel arrays for any column
of lossless WebP files.

Jobs: a map encodes the texts and writes the media table to the shared folder; a map reads the stored bytes back, decodes
them and computes features. Nothing is shuffled.

Defined results: null or empty text is one row of bytes 255; equal texts have equal media and features; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideframe.llm.shared import documents, prepare, stored
from tideframe.llm.textops import chunks, text_buffers
from tideframe.llm.webp_lossless import (
    CROSS_COLOUR, DISTANCES, LENGTHS, LITERALS, PALETTE, PREDICTOR, SUBTRACT_GREEN, BitWriter, Header, code_lengths, codes, decode_images, encode, prefix_of, riff, split_riff, write_code,
)

_U32, _U64 = np.uint32, np.uint64
#: Bytes in a row of pixels, rows in an image.
ROW, TILE = 576, 16
WIDTH = ROW // 4
#: Other ways to write are tried for images with at most this share of different pixels (as counted by SLOTS hash values).
REPEATS, SLOTS = 0.1, 4096
#: Colours that a palette can hold, bits of a colour cache, and blocks of 32 pixels for predictor and cross-colour.
FEW, CACHE, BLOCK = 256, 6, 5
#: Bytes that get short codes, the commonest first; then capitals, digits, other bytes.
COMMON = b" etaonirshdlucmfgpwbyvk.,\njxqz"
_known: list[tuple[bytes, int, Header]] = []


def _fixed() -> tuple[bytes, int, list[np.ndarray], list[np.ndarray]]:
    """(header bits after the size fields as bytes, their number, reversed codes and lengths of the five alphabets)."""
    counts = Counter({c: 20 for c in range(256)})
    counts.update({c: 100 for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(0xA0, 0xC0)) + b"\xc3"})
    counts.update({c: max(400, 16000 // (k + 2)) for k, c in enumerate(COMMON)})
    counts[255] += 40
    byte = code_lengths(counts, 256)
    green = code_lengths(Counter({**counts, **{LITERALS + k: 20 for k in range(LENGTHS)}}), LITERALS + LENGTHS)
    distance = [0] * DISTANCES
    distance[1] = 1  # the second distance code: the pixel before
    lengths = [green, byte, byte, byte, distance]
    w = BitWriter()
    w.write(0, 3)  # no transform, no colour cache, one group
    for x in lengths:
        write_code(w, x)
    return w.bytes(), w.n, [np.array(codes(x), _U64) for x in lengths], [np.array(x, np.int64) for x in lengths]


_HEADER, _HEADER_BITS, _CODES, _LENGTHS = _fixed()


def encode_tiles(pixels: np.ndarray, first: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """VP8L data of many images with the fixed codes. ``first``: each image's first pixel; ``rows``: its rows."""
    n = len(pixels)
    run_with = np.zeros(n, bool)
    run_with[1:] = pixels[1:] == pixels[:-1]
    run_with[first] = False
    # a run of copies of the pixel before becomes one reference if it has three or more
    edge = np.flatnonzero(np.diff(np.r_[False, run_with, False]))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= 3
    start, stop = start[long], stop[long]
    literal = np.ones(n + 1, np.int64)
    step = np.zeros(n + 1, np.int64)
    step[start] += 1
    step[stop] -= 1
    literal = np.cumsum(step)[:n] == 0
    ref = np.zeros(n, bool)
    ref[start] = True
    at = np.flatnonzero(literal | ref)
    is_ref = ref[at]
    px = pixels[at]
    value, size = np.zeros(len(at), _U64), np.zeros(len(at), np.int64)
    for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
        byte = (px >> _U32(shift) & _U32(255)).astype(np.int64)
        value |= _CODES[k][byte] << size.astype(_U64)
        size += _LENGTHS[k][byte]
    if len(start):
        marks = [prefix_of(int(x)) for x in range(1, WIDTH * TILE + 1)]
        run = stop - start - 1
        symbol, extra, bits = (np.array([m[k] for m in marks])[run] for k in range(3))
        value[is_ref] = _CODES[0][LITERALS + symbol] | extra.astype(_U64) << _LENGTHS[0][LITERALS + symbol].astype(_U64)
        size[is_ref] = _LENGTHS[0][LITERALS + symbol] + bits
    image = np.searchsorted(first, at, "right") - 1
    ends = np.cumsum(size)
    lead = np.searchsorted(at, first)
    before = np.r_[0, ends][lead]
    total = np.r_[ends, 0][np.r_[lead[1:], len(at)] - 1] - before  # bits of each image's tokens
    words = (_HEADER_BITS % 8 + total + 63) // 64 + 1
    base = np.r_[0, np.cumsum(words)]
    spot = 64 * base[image] + _HEADER_BITS % 8 + (ends - size) - before[image]
    word, shift = spot >> 6, (spot & 63).astype(_U64)
    stream = np.zeros(base[-1], _U64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    stream[word[new]] = np.bitwise_or.reduceat(value << shift, new)
    over = np.flatnonzero(shift.astype(np.int64) + size > 64)
    stream[word[over] + 1] |= value[over] >> (_U64(64) - shift[over])
    raw = stream.view(np.uint8)
    whole = _HEADER_BITS // 8
    out = []
    for k in range(len(first)):
        body = bytearray(raw[8 * base[k] : 8 * base[k] + (_HEADER_BITS % 8 + int(total[k]) + 7) // 8].tobytes())
        if _HEADER_BITS % 8:
            body[0] |= _HEADER[whole]
        fields = WIDTH - 1 | (int(rows[k]) - 1) << 14 | 1 << 28
        out.append(b"\x2f" + fields.to_bytes(4, "little") + _HEADER[:whole] + bytes(body))
    return out


def _varied(pixels: np.ndarray, first: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Share of different pixels in each image, by hash values."""
    image = np.repeat(np.arange(len(first)), height * WIDTH)
    spot = image * SLOTS + (pixels * _U32(0x9E3779B1) >> _U32(20)).astype(np.int64)
    used = np.bincount(spot, minlength=len(first) * SLOTS).reshape(-1, SLOTS) > 0
    return used.sum(1) / (height * WIDTH)


def _other_ways(tile: np.ndarray) -> list[bytes]:
    """An image that repeats its pixels, written in the ways that suit it."""
    rows = tile.reshape(-1, WIDTH)
    blocks = -(-len(rows) >> BLOCK) * (-(-WIDTH >> BLOCK))
    out = [encode(tile, WIDTH, cache_bits=CACHE)]
    if len(np.unique(tile)) <= FEW:
        out.append(encode(tile, WIDTH, ((PALETTE,),)))
    if len(rows) > 1 and np.mean(rows[1:] == rows[:-1]) > 0.5:  # rows like the one above
        out.append(encode(tile, WIDTH, ((PREDICTOR, BLOCK, np.full(blocks, 2 << 8)),), CACHE))
    green = tile >> _U32(8) & _U32(255)
    if np.mean((tile >> _U32(16) & _U32(255) == green) & (tile & _U32(255) == green)) > 0.5:  # one byte again and again
        out.append(encode(tile, WIDTH, ((SUBTRACT_GREEN,),), CACHE))
        out.append(encode(tile, WIDTH, ((CROSS_COLOUR, BLOCK, np.full(blocks, 32 | 32 << 8)),), CACHE))
    return out


def encode_texts(flat: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> list[bytes]:
    """Media of the documents lo..hi-1."""
    sizes = np.diff(bounds[lo : hi + 1])
    rows = np.maximum(1, -(-sizes // ROW))
    base = np.r_[0, np.cumsum(rows)]
    payload = np.full(int(base[-1]) * ROW, 255, np.uint8)
    place = np.repeat(base[:-1] * ROW - (bounds[lo:hi] - bounds[lo]), sizes) + np.arange(int(sizes.sum()))
    payload[place] = flat[bounds[lo] : bounds[hi]]
    pixels = payload.reshape(-1, 4)[:, ::-1].copy().view(_U32).ravel()  # the first byte is alpha
    tiles = -(-rows // TILE)
    doc = np.repeat(np.arange(hi - lo), tiles)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    first_row = base[doc] + turn * TILE
    height = np.minimum(TILE, base[doc + 1] - first_row)
    first = first_row * WIDTH
    images = encode_tiles(pixels, first, height)
    for k in np.flatnonzero(_varied(pixels, first, height) <= REPEATS):
        images[k] = min([images[k], *_other_ways(pixels[first[k] : first[k] + height[k] * WIDTH])], key=len)
    out = [b""] * (hi - lo)
    for d, image in zip(doc.tolist(), images, strict=True):
        out[d] += riff(image)
    return out


def decode_media(media: list[bytes]) -> list[bytes]:
    """Payloads of media values: all their images are decoded in step."""
    files = [split_riff(m) for m in media]
    images = iter(decode_images([x for f in files for x in f], _known))
    return [b"".join(next(images)[2].astype(">u4").tobytes() for _ in f) for f in files]


def _images(media: list[bytes | None]) -> list[list[dict] | None]:
    """The images of each value, decoded in step; of values that are no lossless WebP files, or broken ones, None."""
    try:
        files = [split_riff(m or b"") for m in media]
        images = iter(decode_images([x for f in files for x in f], _known))
        return [[{"width": w, "height": h, "pixels": p.astype(np.int64)} for w, h, p in (next(images) for _ in f)] for f in files]
    except (ValueError, IndexError, KeyError, OverflowError, struct.error):
        return [None] if len(media) == 1 else [x for m in media for x in _images([m])]


def _pixel_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int64()))]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_images(batch.column(1).to_pylist()), kind)], ["doc_id", "images"])


def media_pixels(media: DataFrame, column: str = "media") -> DataFrame:
    """(doc_id, images): width, height and ARGB pixels of all lossless WebP files in a binary column; none for a null value,
    and null for a value that can't be decoded."""
    prepare(media.sparkSession)
    return media.select("doc_id", column).mapInArrow(_pixel_arrays, "doc_id long, images array<struct<width int, height int, pixels array<long>>>")


def feature(payload: bytes) -> str:
    """64 bits as 16 hex digits: which of 64 stretches of the samples are brighter than the whole."""
    x = np.frombuffer(payload, np.uint8)
    cut = np.linspace(0, len(x), 65).astype(np.int64)
    means = np.add.reduceat(x, cut[:-1], dtype=np.int64) / np.diff(cut)
    return np.packbits(means > x.mean()).tobytes().hex()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bounds = text_buffers(batch.column(1))
        for lo, hi in chunks(bounds, 4 << 20):
            n = np.diff(bounds[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(encode_texts(flat, bounds, lo, hi), pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        media = batch.column(2).to_pylist()
        for m, p in zip(media, decode_media(media), strict=True):
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of ``docs``, written to the shared folder and opened again."""
    prepare(docs.sparkSession)
    return stored(documents(docs, "doc_id", "text").mapInArrow(_write, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the pixels that the stored ``media`` decode to."""
    prepare(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, schema)
