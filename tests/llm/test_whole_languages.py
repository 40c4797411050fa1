"""Languages that few documents of a large table declare: with a model, without one, and tables of these alone."""

import random

from pyspark.sql import functions as F

from tideframe.llm.language_id import identify


def _texts(rng, letters, n, words):
    stock = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(400)]
    return [" ".join(rng.choices(stock, k=words)) for _ in range(n)]


def _found(spark, rows):
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    return {r["doc_id"]: r for r in identify(docs, "text", F.col("lang")).collect()}


def test_small_languages(spark):
    rng = random.Random(6)
    common = [(t, "en") for t in _texts(rng, "aeiounstrhl", 8000, 12)]
    small = [(t, "xh") for t in _texts(rng, "qxzkwyvjgb", 12, 250)]  # under a share of 0.002
    single = [(t, "yi") for t in _texts(rng, "אבגדהוזחטיכל", 2, 60)]
    undeclared = [(small[0][0], None)]
    out = _found(spark, common + small + single + undeclared + [("", "yi")])
    for k, (_, lang) in enumerate(common + small + single):
        assert (out[k]["language"], out[k]["rejected"]) == (lang, False)
    last = len(common) + len(small) + len(single)
    assert (out[last]["language"], out[last]["rejected"]) == ("xh", False)
    assert (out[last + 1]["language"], out[last + 1]["rejected"]) == ("und", True)


def test_many_languages(spark):
    rng = random.Random(7)
    rows = []
    for k in range(70):  # more than 64, each of its own letters
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        rows += [(t, f"l{chr(97 + k // 26)}{chr(97 + k % 26)}") for t in _texts(rng, letters, 6, 120)]
    out = _found(spark, rows)
    assert all((out[k]["language"], out[k]["rejected"]) == (lang, False) for k, (_, lang) in enumerate(rows))


def test_declarations_alone(spark):
    out = _found(spark, [("word " * 9, "en"), ("worte", "DE-at"), ("", "en"), ("none", None)])
    assert [(out[k]["language"], out[k]["rejected"]) for k in range(4)] == [("en", False), ("de", False), ("und", True), ("und", True)]
