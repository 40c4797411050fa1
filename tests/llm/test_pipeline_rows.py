"""The pipeline's rows on small tables against plain Python, stage by stage."""

import re
import zlib

import numpy as np
import pytest

from tests.llm import brute

JUNK = ["0123 456 " * 9, "--- *** ###", "qzxkvjq wqxzj kqzvx xqjzkw vzqxk jqkzx wvxqz " * 6]


def _stage(spark, out, k, root):
    path = f"{root}/stage-{k}"
    out.write.parquet(path)
    return spark.read.parquet(path)


def test_rows(spark, data, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    from tideframe.llm.training import fold

    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10_000_000 + k, text, None, f"none{k}", len(text)) for k, text in enumerate(JUNK)], docs.schema)
    docs.union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/sf0.01/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = [f for _, f in pipeline.STAGES]
    start = text_of(docs)

    kept = _stage(spark, stages[0](spark, docs, str(tmp_path)), 0, tmp_path)
    languages = text_of(kept)
    gone = set(start) - set(languages)
    assert gone >= {10_000_000 + k for k in range(len(JUNK))} and all(len(re.findall("[^\\W\\d_]{2,}", start[d] or "")) < 8 for d in gone if d < 10_000_000)

    clean = _stage(spark, stages[1](spark, kept, str(tmp_path)), 1, tmp_path)
    polite = text_of(clean)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{tmp_path}/labels.parquet").where(fold("doc_id", 4) == 2).collect() if r["doc_id"] in languages}
    assert sum((d not in polite) == bool(t) for d, t in labels.items()) >= 0.93 * len(labels)  # some 300 rows to learn from

    unique = _stage(spark, stages[2](spark, clean, str(tmp_path)), 2, tmp_path)
    singles = text_of(unique)
    expected = {d for d, (_, c) in brute.components(list(polite.items()), 5, 80).items() if c == d}
    assert set(singles) == expected and all(singles[d] == start[d] for d in singles)

    rest = _stage(spark, stages[3](spark, unique, str(tmp_path)), 3, tmp_path)
    assert rest.columns == docs.columns
    removed = brute.without_repeats(list(singles.items()))
    for r in rest.collect():
        _, n, digest = removed[r["doc_id"]]
        assert r["text"] == singles[r["doc_id"]] if not n else brute.digest(r["text"]) == digest
        assert r["n_chars"] == len(r["text"])

    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in text_of(rest).items()}
    found = {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(ids)
    for d, own in found.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids[d])
        assert all(r["ids_crc32"] == zlib.crc32(ids[d][r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
