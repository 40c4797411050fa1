"""Round trips of the lossless WebP codec over all features of the format."""

import numpy as np
import pytest

from tideframe.llm.webp_lossless import CROSS_COLOUR, NEAR, PALETTE, PREDICTOR, SUBTRACT_GREEN, decode_images, encode


def _trip(px, width, **how):
    (w, h, out), = decode_images([encode(px, width, **how)], [])
    assert (w, h) == (width, len(px) // width) and (out == px).all(), how


@pytest.mark.parametrize("seed", range(12))
def test_round_trip(seed):
    rng = np.random.default_rng(seed)
    w, h = int(rng.integers(1, 40)), int(rng.integers(1, 20))
    n = w * h
    pick = lambda k: rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)
    px = (pick(n), rng.choice(pick(int(rng.integers(1, 20))), n), np.repeat(pick(1), n), rng.choice(pick(3), n))[seed % 4]
    blocks = lambda b: ((w + (1 << b) - 1) >> b) * ((h + (1 << b) - 1) >> b)
    _trip(px, w)
    _trip(px, w, references=False)
    _trip(px, w, cache_bits=int(rng.integers(1, 12)))
    _trip(px, w, transforms=((SUBTRACT_GREEN,),))
    for mode in range(14):
        _trip(px, w, transforms=((PREDICTOR, 2, np.full(blocks(2), mode << 8)),))
    _trip(px, w, transforms=((PREDICTOR, 3, rng.integers(0, 14, blocks(3)) << 8), (CROSS_COLOUR, 2, rng.integers(0, 1 << 24, blocks(2))), (SUBTRACT_GREEN,)), cache_bits=4)
    _trip(px, w, groups=(2, rng.integers(0, 3, blocks(2))), cache_bits=2)
    if seed % 4:
        _trip(px, w, transforms=((PALETTE,),), cache_bits=3)


def test_many_in_step():
    rng = np.random.default_rng(5)
    images, expected = [], []
    for k in range(40):
        w, h = int(rng.integers(1, 40)), int(rng.integers(1, 20))
        px = rng.choice(rng.integers(0, 2**32, 50, dtype=np.uint64).astype(np.uint32), w * h)
        images.append(encode(px, w, cache_bits=k % 5))
        expected.append(px)
    assert all((a[2] == b).all() for a, b in zip(decode_images(images, []), expected, strict=True))


def test_distance_map():
    assert len(NEAR) == 120 and NEAR[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and NEAR[-1] == (8, 7)


def test_ways_to_write():
    """Repeating texts are written in other ways where these are smaller, and every way is read back."""
    import pyarrow as pa

    from tideframe.llm import media_columns as M
    from tideframe.llm.textops import text_buffers
    from tideframe.llm.webp_lossless import read_header, split_riff

    rng = np.random.default_rng(3)
    line = "".join(rng.choice(list("abcdefgh "), 576))
    texts = ["", "x" * 9000, "=" * 4000 + "-" * 4000, "ab" * 4000, line * 15, (line[:560] + "\n") * 30, "".join(rng.choice(list("etaoin "), 3000)), "no repeats here: " + line[:300], "é" * 800, "".join(rng.choice(["abcd", "efgh"], 2000))]
    flat, bounds = text_buffers(pa.array(texts))
    media = M.encode_texts(flat, bounds, 0, len(texts))
    for text, raw in zip(texts, M.decode_media(media), strict=True):
        assert raw.rstrip(b"\xff") == text.encode()
    headers = [read_header(x)[2] for m in media for x in split_riff(m)]
    kinds = {t[0] for h in headers for t in h.transforms}
    assert {PALETTE, SUBTRACT_GREEN} <= kinds and len({h.cache_bits for h in headers}) > 1
    for tile in (np.tile(rng.integers(0, 2**32, M.WIDTH, dtype=np.uint64).astype(np.uint32), 6), np.full(M.WIDTH * 3, 0x3D3D3D3D, np.uint32), np.repeat(rng.integers(0, 256, M.WIDTH * 2, dtype=np.uint64).astype(np.uint32), 2) * np.uint32(0x01010101)):
        ways = M._other_ways(tile)
        assert all((out == tile).all() for (_, _, out) in decode_images(ways, []))


def test_pixel_arrays(spark):
    from tideframe.llm.media_columns import media_pixels, media_table

    docs = spark.createDataFrame([(1, "abcd" * 200), (2, None), (3, "z")], "doc_id long, text string")
    rows = {r["doc_id"]: r["images"] for r in media_pixels(media_table(docs)).collect()}
    assert [(i["width"], i["height"]) for i in rows[1]] == [(144, 2)] and rows[1][0]["pixels"][:3] == [0x61626364] * 3
    assert rows[3][0]["pixels"][0] == 0x7AFFFFFF and rows[2][0]["pixels"] == [0xFFFFFFFF] * 144
    none = media_pixels(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()
    assert none[0]["images"] == []


def test_malformed_media(spark):
    """A broken value is null and harms none of the others in its batch."""
    from tideframe.llm.media_columns import media_pixels, media_table

    good = {r["doc_id"]: bytes(r["media"]) for r in media_table(spark.createDataFrame([(1, "abcd" * 200), (2, "z")], "doc_id long, text string")).collect()}
    rows = [(1, good[1]), (2, b"abc"), (3, good[1][:-40]), (4, good[2]), (5, None), (6, b"RIFF" + b"\xff" * 40), (7, good[1][:30])]
    got = {r["doc_id"]: r["images"] for r in media_pixels(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()}
    assert got[1][0]["pixels"][:3] == [0x61626364] * 3 and got[4][0]["width"] == 144 and got[5] == []
    assert [got[k] for k in (2, 3, 6, 7)] == [None] * 4
