"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import brute

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("key", "host", "label", "score", "h", "owner", "class_id", "n_shingles", "comp", "length", "part", "rank", "best", "declared", "words", "at")),
    ]
)


def _rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = " ".join(rng.choices(words, k=120))
    near = base.split()
    near[60] = "other"
    texts = [None, "", " \t\n", "one", "one two", "one two three four", base, base, " ".join(near), base.upper(), "x " * 4000 + "é" * 3000, "ÿ🙂 漢字 " * 40, "a\x00b\x0bc", base[: len(base) // 2] + " tail words here"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(6, base), (None, base), (None, None), (99, " ".join(rng.choices(words, k=20000)))]
    return [(d, t, [None, "en", "de", "EN-us"][k % 4], [None, "src0"][k % 2], None if t is None else len(t), *("z" * (k % 3) for _ in range(16))) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(_rows(), SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(14)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def _texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}


def test_scores(spark, docs, labels):
    from tideframe.llm.quality_classifier import quality_scores
    from tideframe.llm.toxicity import toxicity_scores

    for scored in (quality_scores, toxicity_scores):
        out = scored(docs, labels, F.lit(True)).collect()
        assert _ids(out) == _ids(docs.collect()) and all(0 <= r["score"] <= 1 for r in out)
        by = {}
        for r in out:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(by[6]) == 1 and by[0] == by[1] == by[2]
        assert scored(_empty(spark), labels, F.lit(True)).count() == 0
        assert {r["score"] for r in scored(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_near_duplicates(spark, docs):
    from tideframe.llm.jaccard_join import drop_near_duplicates, near_duplicates

    for size, percent in ((4, 85), (5, 80)):
        out = near_duplicates(docs, size, percent).collect()
        assert _ids(out) == _ids(docs.collect())
        expected = brute.components(list(_texts(docs).items()), size, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == expected
    kept = drop_near_duplicates(docs, 4, 85)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {d for d, (_, c) in brute.components(list(_texts(docs).items()), 4, 85).items() if c == d}
    assert near_duplicates(_empty(spark)).count() == 0


def test_language(spark, docs):
    from tideframe.llm.language_id import identify

    out = identify(docs, "text", F.col("lang"), F.col("source"))
    rows = out.collect()
    assert _ids(rows) == _ids(docs.collect())
    for r in rows:
        if r["doc_id"] in (0, 1, 2):
            assert (r["language"], r["confidence"], r["rejected"]) == ("und", 0.0, True)
    assert identify(_empty(spark), "text", F.col("lang"), F.col("source")).count() == 0
    assert {r["language"] for r in identify(docs, "text").collect()} == {"und"}


def test_media(spark, docs):
    from tideframe.llm.media_columns import media_features, media_table

    rows = media_features(media_table(docs)).collect()
    assert _ids(rows) == _ids(docs.collect())
    texts = _texts(docs)
    for r in rows:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert media_features(media_table(_empty(spark))).count() == 0


def test_substrings(spark, docs):
    from tideframe.llm.substring_dedup import lengths, remove_repeats

    rows = remove_repeats(docs, 50, carry=("lang", "key")).collect()
    assert _ids(rows) == _ids(docs.collect()) and set(rows[0].asDict()) == {"doc_id", "n_words", "n_removed", "kept_text", "lang", "key"}
    expected = brute.without_repeats(list(_texts(docs).items()))
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) == expected[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    assert remove_repeats(_empty(spark), 50).count() == 0
    assert lengths(50) == [12, 25, 50] and lengths(6) == [3, 6] and lengths(101) == [12, 25, 50, 101]
    long = brute.without_repeats(list(_texts(docs).items()), 101)
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, 101).collect() if r["doc_id"] is not None} == {d: v[1] for d, v in long.items()}
    short = brute.without_repeats(list(_texts(docs).items()), 6)
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, 6).collect() if r["doc_id"] is not None} == {d: v[1] for d, v in short.items()}


def test_pieces(spark, docs):
    import public_tokenizers as P
    import sentencepiece

    from tideframe.llm.piece_bpe import encode_documents

    path = str(P.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = encode_documents(docs, path).collect()
    assert _ids(rows) == _ids(docs.collect())
    texts = _texts(docs)
    for r in rows:
        if r["doc_id"] is not None:
            ids = [*sp.encode(texts[r["doc_id"]] or ""), 2]
            assert r["ids"] == " ".join(map(str, ids)) and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
    assert encode_documents(_empty(spark), path).count() == 0


def test_packing(spark, docs):
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tideframe.llm.packing import pack

    path = str(P.path("byte_bpe_50k.json"))
    slow = Tokenizer.from_file(path)
    rows = pack(docs, path).collect()
    texts = _texts(docs)
    pieces = {}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for d, text in texts.items():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[d], key=lambda r: (r["piece"], r["sequence_id"]))
        times = 2 if d == 6 else 1
        assert len(own) == times * -(-len(ids) // 1024)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and (r["length"] == 1024 or r["piece"] == 0)
    assert pack(_empty(spark), path).count() == 0


def test_quality_rules(spark, docs):
    from tideframe.llm.quality_rules import quality_verdicts

    rows = quality_verdicts(docs).collect()
    assert _ids(rows) == _ids(docs.collect())
    texts = _texts(docs)
    for r in rows:
        if r["doc_id"] is not None:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality_counts(texts[r["doc_id"]])
            assert not (r["base_failed"] and r["kept"])
    assert quality_verdicts(_empty(spark)).count() == 0


def test_pages(spark):
    from tideframe.llm.html_wrapper import main_text

    schema = "page_id long, url string, html string, host string, template string, stats string, place string"
    rows = [(1, "http://a.org/1", None), (2, None, ""), (3, "nonsense", "<"), (4, "http://a.org/2", "plain text &amp; more"), (5, "http://a.org/3", "<p>one<p>two <b>bold</p><div>" * 300), (None, "http://a.org/3", "<article><p>x</p></article>")]
    pages = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows + rows[3:4]], schema)
    out = {(r["page_id"], r["url"]): r for r in main_text(pages).collect()}
    assert len(out) == 6 and main_text(pages).count() == 7
    assert out[1, "http://a.org/1"]["text"] == out[2, None]["text"] == "" and out[4, "http://a.org/2"]["text"] == "plain text & more"
    assert out[5, "http://a.org/3"]["text"].startswith("one\n\ntwo bold")
    assert main_text(pages.limit(0)).count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        out = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, out = out, stage(spark, out, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.count() <= before.count()
        out.collect()
