"""Strings without spaces that are encoded in stretches, and looked-up strings bounded in bytes."""

import base64
import random

import public_tokenizers
import sentencepiece

from tideframe.llm import piece_bpe as B


def _strings():
    rng = random.Random(5)
    yield base64.b64encode(rng.randbytes(30000)).decode()
    yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20000))
    yield "internationalization" * 700
    yield "漢字の文章をそのまま続ける。" * 800
    yield "=" * 9000 + "a" * 9000
    yield "".join(rng.choices("aé漢😀\x00=-_#", k=9000))
    yield "e" * B.STRETCH + "x" + "the" * B.STRETCH


def test_stretches_change_no_ids():
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=path), B.PieceBpe(path)
    for text in _strings():
        for whole in (text, f"two {text}\n{text} words"):
            ids = [*sp.encode(whole), sp.eos_id()]
            assert bpe.encode(whole) == (" ".join(map(str, ids)), sp.decode(ids)), whole[:40]


def test_cuts_are_crossed_by_no_piece():
    bpe = B.PieceBpe(str(public_tokenizers.path("piece_bpe_32k.model")))
    text = base64.b64encode(random.Random(6).randbytes(6000)).decode()
    cut = bpe._cut(text, 100, 4000)
    assert 100 < cut <= 4000
    for p in bpe.id_of:
        assert not any(text.startswith(p, k) for k in range(cut - len(p) + 1, cut))
    assert bpe._cut("internationalization", 0, 5) == 0


def test_kept_strings_are_bounded_in_bytes(monkeypatch):
    bpe = B.PieceBpe(str(public_tokenizers.path("piece_bpe_32k.model")))
    monkeypatch.setattr(B, "KNOWN", 50 * B.ENTRY)
    words = [f"word{k}" for k in range(500)]
    first = [bpe.encode(w) for w in words]
    assert len(bpe.prefixed) + len(bpe.bare) <= 60 and first == [bpe.encode(w) for w in words]
    bpe.encode("z9" * 5000)
    assert "z9" * 5000 not in bpe.prefixed
