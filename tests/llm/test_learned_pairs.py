"""What the trained operators learn: interactions, characters, odd labels, repeated ids."""

import io
import random

import numpy as np
import pyarrow as pa

from tideframe.llm import toxicity as T
from tideframe.llm.textops import characters, text_buffers


def _pairs(n, seed):
    """Toxic exactly when the mark of one kind meets its own of the other kind; no mark tells anything alone."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choices("bcdfghklmnprst", k=8))
    words = random.Random(0)
    neutral = ["".join(words.choices("abcdefghiklmnoprstu", k=6)) for _ in range(800)]
    marks = [["".join(words.choices("bcdfghklmnprst", k=9)) for _ in range(3)] for _ in range(4)]
    texts, labels = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [*rng.choices(neutral, k=40), rng.choice(marks[0 if a else 1]), rng.choice(marks[2 if b else 3]), name()]
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(a == b))
    return texts, labels


def _features(texts, labels):
    flat, bounds = text_buffers(pa.array(texts))
    t, d = T.terms(flat, bounds, 0, len(texts))
    offsets = np.r_[0, np.cumsum(np.bincount(d, minlength=len(texts)))].astype(np.int32)
    return pa.table({"ids": pa.ListArray.from_arrays(offsets, pa.array(t)), "label": pa.array(labels, pa.int32())})


def _accuracy(model, texts, labels):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    scores = next(iter(T._score(model)(iter([batch])))).column(1).to_numpy()
    return np.mean((scores >= 0.5) == np.array(labels))


def test_pairs_that_weights_miss():
    texts, labels = _pairs(2400, 1)
    model = T.fit(_features(texts, labels))
    m = dict(np.load(io.BytesIO(model)))
    m["v"] = m["v"] * 0
    linear = io.BytesIO()
    np.savez(linear, **m)
    held_out = _pairs(800, 2)
    assert _accuracy(model, *held_out) > 0.97
    assert _accuracy(linear.getvalue(), *held_out) < 0.6
    assert _accuracy(T.fit(_features(texts, labels), 0), *held_out) < 0.6


def test_characters():
    text = "aé漢😀 z\x00\x7fÿ"
    found, starts = characters(np.frombuffer(text.encode(), np.uint8))
    assert found.tolist() == [ord(c) for c in text] and starts.tolist() == [len(text[:k].encode()) for k in range(len(text))]
    assert characters(np.zeros(0, np.uint8))[0].tolist() == []


def test_odd_labels_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    from tideframe.llm.quality_classifier import quality_scores
    from tideframe.llm.training import labelled_sample

    docs = spark.createDataFrame([(1, "good text")] * 50 + [(2, "bad text"), (3, "other"), (4, "more"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 2), (4, -1), (5, 1), (6, 1)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", F.lit(True), 100).collect()
    assert sorted((r["text"] or "", r["label"]) for r in sample) == [("", 1), ("bad text", 0), ("good text", 1)]
    assert quality_scores(docs, labels, F.lit(True)).count() == 54
