"""Quality classifier of supervised subword embeddings.

Every word and every n-gram of 3 and 4 characters within " word " has a learned vector in a hashed table. A document is the
mean of its vectors, a softmax layer over that gives the class probabilities, and both are trained by stochastic gradient
descent in NumPy. Two more features of the same kind tell repetition: a word that equals its predecessor, and a word
whose three-word shingle stood before in the same text.

Training uses at most SAMPLE labelled rows (those with the smallest id hashes, so the same ones at every size); scoring
reads every whole text once, without a shuffle. Since the layer is linear, scoring averages one number for each feature.

Defined results: null or empty text has no features and gets the score of the bias; without any labelled row all scores
are 0.5; labels other than 0 and 1 are ignored; repeated rows get equal scores; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import documents, prepare
from tideframe.llm.textops import Words, characters, chunks, pair, text_buffers
from tideframe.llm.training import labelled_sample, train

_U = np.uint64
#: Labelled rows that training may see at most.
SAMPLE = 6000
#: Rows of the hashed vector table for words and for n-grams, vector size, passes over the sample, first step size.
WORD_BUCKETS, GRAM_BUCKETS, SIZE, EPOCHS, RATE = 1 << 16, 1 << 15, 8, 6, 2.0
GRAMS = (3, 4)
BUCKETS = WORD_BUCKETS + len(GRAMS) * GRAM_BUCKETS + 2
#: A document is predicted good from this score on.
THRESHOLD = 0.3


def features(flat: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, document) arrays of the documents lo..hi-1, kind after kind, documents in order."""
    w = Words(flat, bounds, lo, hi)
    h, doc = w.hashes(), w.doc_of()
    yield (h >> _U(48)).astype(np.int64) & (WORD_BUCKETS - 1), doc
    b, starts = characters(w.bytes)
    space = (b == 32) | ((b - np.uint32(9)) <= 4)
    b[space] = 32
    at = np.repeat(np.arange(hi - lo), np.diff(w.edges))[starts]
    for k, n in enumerate(GRAMS):
        m = len(b) - n + 1
        if m <= 0:
            continue
        x = b[:m].copy()
        inner = np.zeros(m, bool)
        for i in range(1, n):
            x = x * np.uint32(0x01000193) + b[i : i + m]
            if i < n - 1:
                inner |= space[i : i + m]
        ok = ~inner & (at[:m] == at[n - 1 :])
        x = (x[ok] * np.uint32(0x9E3779B1)) >> np.uint32(17)
        yield x.astype(np.int64) + (WORD_BUCKETS + k * GRAM_BUCKETS), at[:m][ok]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    yield np.full(int(again.sum()), BUCKETS - 2), doc[again]
    if len(h) > 2:
        three = pair(pair(h[:-2], h[1:-1], 1), h[2:], 2)
        d = doc[:-2]
        order = np.lexsort((three, d))
        twice = order[1:][(three[order[1:]] == three[order[:-1]]) & (d[order[1:]] == d[order[:-1]])]
        twice.sort()
        yield np.full(len(twice), BUCKETS - 1), d[twice]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bounds = text_buffers(batch.column(0))
        for lo, hi in chunks(bounds):
            kinds = list(features(flat, bounds, lo, hi))
            f, d = np.concatenate([x[0] for x in kinds]), np.concatenate([x[1] for x in kinds])
            order = np.argsort(d, kind="stable")
            ids, counts = [], []
            for part in np.split(f[order], np.cumsum(np.bincount(d, minlength=hi - lo))[:-1]):
                u, c = np.unique(part, return_counts=True)
                ids.append(u.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), batch.column(1).slice(lo, hi - lo)], ["ids", "counts", "label"])


def fit(rows: pa.Table) -> bytes:
    """Stochastic gradient descent over (ids, counts, label); the vectors, the layer and its bias as an npz file."""
    rng = np.random.default_rng(7)
    label = rows.column("label").to_numpy()
    ids = [x.values.to_numpy() for x in rows.column("ids")]
    mean = []
    for x in rows.column("counts"):
        c = x.values.to_numpy().astype(np.float32)
        mean.append(c / max(1.0, c.sum()))
    order = np.lexsort((label, [len(x) for x in ids], [int(x[:8].sum()) for x in ids]))  # tasks deliver in any order
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    layer, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    total, seen = EPOCHS * len(label), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            rate = RATE * (1 - seen / total)
            seen += 1
            if not len(ids[i]):
                continue
            rows_i = vectors[ids[i]]
            hidden = mean[i] @ rows_i
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= 0.05 * rate * p
            vectors[ids[i]] = rows_i - (rate * 20) * np.outer(mean[i], back)
    out = io.BytesIO()
    np.savez(out, vectors=vectors, layer=layer, bias=bias)
    return out.getvalue()


def _score(model: bytes | None):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            m = np.load(io.BytesIO(model))
            way = m["layer"][:, 1] - m["layer"][:, 0]
            table, bias = (m["vectors"] @ way).astype(np.float64), float(m["bias"][1] - m["bias"][0])
        else:
            table, bias = np.zeros(BUCKETS), 0.0
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            scores = np.zeros(batch.num_rows)
            for lo, hi in chunks(bounds):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for f, d in features(flat, bounds, lo, hi):
                    total += np.bincount(d, table[f], hi - lo)
                    n += np.bincount(d, minlength=hi - lo)
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return job


def quality_scores(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; learns ``labels.quality`` from the rows that ``use`` admits."""
    prepare(docs.sparkSession)
    docs = documents(docs, "doc_id", "text")
    model = train(labelled_sample(docs, labels, "quality", use, SAMPLE), _featurise, fit, "ids array<int>, counts array<int>, label int")
    out = docs.mapInArrow(_score(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
