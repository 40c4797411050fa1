"""The registered queries against brute-force versions, exact round trips and held-out labels."""

import hashlib
import html
import re

import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tideframe.llm import queries as Q


@pytest.fixture(scope="module")
def sf(data):
    return f"{data}/sf0.001"


@pytest.fixture(scope="module")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def _rows(spark, name, sf):
    return {r[0]: r for r in Q.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name, label, fold", [("op1_quality_classifier", "quality", 0), ("op6_toxicity", "toxic", 2)])
def test_held_out(spark, data, name, label, fold):
    import zlib

    rows = _rows(spark, name, f"{data}/sf0.1")
    parts = 5 if fold == 0 else 4
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % parts == fold) and r["predicted"] == int(r["score"] >= 0.3) for d, r in rows.items())
    labels = pq.read_table(f"{data}/sf0.1/labels.parquet").to_pylist()
    seen = [(x[label], rows[x["doc_id"]]["predicted"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in seen) / len(seen) > 0.95
    hits = [b for a, b in seen if a == 1]
    assert sum(hits) / len(hits) > 0.85


def test_jaccard_join(spark, sf, texts):
    assert {d: (r[1], r[2]) for d, r in _rows(spark, "op2_ngram_jaccard_join", sf).items()} == brute.components(list(texts.items()), 4, 85)


def test_language(spark, sf):
    declared = {x["doc_id"]: x["lang"] for x in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = _rows(spark, "op3_language_id", sf)
    assert sum(r["language"] == declared[d] for d, r in rows.items()) / len(rows) > 0.97 and sum(r["kept"] for r in rows.values()) / len(rows) > 0.97
    pages = _rows(spark, "language_id_pages", sf)
    urls = {x["page_id"]: x["url"] for x in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    assert sum(f"/{r['language']}/" in urls[p] for p, r in pages.items()) / len(pages) > 0.9


def test_html(spark, sf):
    rows = _rows(spark, "op4_html_extraction", sf)
    for page in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        expected = "\n\n".join(x for x in parts if x)
        assert (rows[page["page_id"]]["text"], rows[page["page_id"]]["n_chars"]) == (expected, len(expected))


def test_media(spark, sf, texts):
    import zlib

    for d, r in _rows(spark, "op5_media_columns", sf).items():
        raw = (texts[d] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_substrings(spark, sf, texts):
    assert {d: tuple(r)[1:] for d, r in _rows(spark, "op7_substring_dedup", sf).items()} == brute.without_repeats(list(texts.items()))


def test_pieces(spark, sf, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for d, r in _rows(spark, "op8_sentencepiece", sf).items():
        ids = [*sp.encode(texts[d] or ""), 2]
        assert (r[1], r[2], r[3]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_packing(spark, sf):
    rows = Q.QUERIES["op9_best_fit_packing"](spark, sf).collect()
    total, used = sum(r["length"] for r in rows), {r["sequence_id"] for r in rows}
    assert len(used) <= 1.03 * -(-total // 1024)


def test_quality_rules(spark, sf, texts):
    rows = _rows(spark, "op10_quality_rules", sf)
    assert {d: tuple(r)[1:7] for d, r in rows.items()} == {d: brute.quality_counts(t) for d, t in texts.items()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    wrong = [x for x in labels if rows[x["doc_id"]]["kept"] != bool(x["quality"]) and not rows[x["doc_id"]]["base_failed"]]
    assert len(wrong) <= 0.05 * len(labels)


def test_fuzzed_pieces():
    import random

    import public_tokenizers
    import sentencepiece

    from tideframe.llm.piece_bpe import model

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=path), model(path)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "▁", "\t", "é", "😀", "00", "----", "\r\n", "\x00", "漢", "</s>", "<0x0A>", *rng.sample(sorted(bpe.id_of), 500)]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        ids = [*sp.encode(s), 2]
        assert bpe.encode(s) == (" ".join(map(str, ids)), sp.decode(ids)), repr(s)


def test_packing_plan():
    import numpy as np

    from tideframe.llm.packing import plan

    rng = np.random.default_rng(2)
    for scale in (1, 30, 3000):
        counts = rng.poisson(scale * np.exp(-np.arange(1025) / 300))
        counts[0] = 0
        have = np.zeros(1025, int)
        for config, copies in (made := plan(counts, 1024)):
            assert sum(n * m for n, m in config.items()) <= 1024
            for n, m in config.items():
                have[n] += m * copies
        assert (have == counts).all() and sum(c for _, c in made) <= 1.01 * (counts * np.arange(1025)).sum() / 1024 + 2


def test_estimated_accuracies():
    """Votes of known accuracy, drawn independently: the estimate finds the rates that made them."""
    import collections
    import math
    import random

    from tideframe.llm.quality_rules import estimate

    rng = random.Random(4)
    rates = [(0.95, 0.3), (0.9, 0.2), (0.97, 0.4), (0.85, 0.1), (0.92, 0.35)]  # a rule says good of so many good and bad ones
    counts = collections.Counter()
    for _ in range(60000):
        good = rng.random() < 0.8
        counts[tuple(0 if rng.random() < 0.1 else 1 if rng.random() < r[0 if good else 1] else -1 for r in rates)] += 1
    base, odds = estimate(sorted(counts.items()))
    assert abs(1 / (1 + math.exp(-base)) - 0.8) < 0.03
    for (up, down), (tell, lie) in zip(odds, rates, strict=True):
        assert abs(up - math.log(tell / lie)) < 0.15 and abs(down - math.log((1 - tell) / (1 - lie))) < 0.15
