"""Languages of texts whose declaration is wrong or missing, measured against the true ones, and junk among them."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tideframe.llm.language_id import identify

JUNK = ["0123 4567 89", "%%% *** ### $$$", "-----\n=====", "qzxkvjq wqxzj kqzvx xqjzkw vzqxk jqkzx wvxqz " * 6, "zq9 xkj7 qv3 " * 40, "\u0001\u0002 \u0003", "| | | |"]


def test_wrong_and_missing_declarations(spark, data):
    rng = random.Random(8)
    rows, truth = [], {}
    for x in pq.read_table(f"{data}/sf0.01/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist():
        if len((x["text"] or "").split()) < 8:
            continue
        said = rng.random()
        lang = None if said < 0.3 else rng.choice([y for y in ("en", "fr", "de", "es") if y != x["lang"]]) if said < 0.4 else x["lang"]
        truth[x["doc_id"]] = (x["lang"], "missing" if said < 0.3 else "wrong" if said < 0.4 else "right")
        rows.append((x["doc_id"], x["text"], lang, x["source"]))
    rows += [(1_000_000 + k, text, None, f"src{k}") for k, text in enumerate(JUNK)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in identify(docs, "text", F.col("lang"), F.col("source")).collect()}
    for kind, least in (("right", 0.99), ("missing", 0.98), ("wrong", 0.95)):
        mine = [d for d, (_, k) in truth.items() if k == kind]
        assert sum(out[d]["language"] == truth[d][0] for d in mine) >= least * len(mine), kind
        assert sum(not out[d]["rejected"] for d in mine) >= 0.99 * len(mine), kind
    assert [text for k, text in enumerate(JUNK) if not out[1_000_000 + k]["rejected"]] == []
