"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (letters and digits, lower-cased in ASCII) and their first 4 to 8 bytes, hashed to 2**28
buckets and taken once for each document. The score is the logistic of
``w0 + sum w_i + 1/2 sum_f ((sum v_if)**2 - sum v_if**2)``: besides each term's weight it has every pair's interaction,
the product of two learned factor vectors, which additive weights miss. Training is by AdaGrad in NumPy.

Training uses at most SAMPLE labelled rows (those with the smallest id hashes, so the same ones at every size; labels other
than 0 and 1 are ignored). So that the many neutral words of long texts add no noise, a term of at least LEAST sampled
documents enters the model only by evidence of one of three kinds: its own share of toxic documents can't be chance; a
pair it forms, of the PAIRED commonest terms, has a share that the two terms' own shares don't explain, so terms that
matter only in pairs are found too; or, after a first fit, the errors in its documents, by themselves or growing with the
score, can't be chance. Scoring reads every whole text once, without a shuffle.

Defined results: null or empty text gets the score of the bias; without any labelled row all scores are 0.5; repeated
rows get equal scores; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import documents, prepare
from tideframe.llm.textops import LETTERS, LOWER_CODE, Words, chunks, text_buffers
from tideframe.llm.training import labelled_sample, train

_U = np.uint64
#: Labelled rows that training may see at most, and documents of these that a term of the model is in at least.
SAMPLE, LEAST = 12000, 4
#: Evidence for a term alone, and for a pair of the PAIRED commonest ones in EVER or more documents, in standard deviations.
DEVIATIONS, PAIR_DEVIATIONS, PAIRED, EVER = 4.0, 6.0, 2048, 8
#: Fits, each on the terms that the errors of the one before it add.
ROUNDS = 3
#: Factors of a term and their first size, passes over the sample, step sizes and decay of weights and of factors.
FACTORS, FIRST, EPOCHS, RATE, FACTOR_RATE, DECAY, FACTOR_DECAY = 4, 0.02, 6, 0.05, 0.02, 1e-4, 1e-3
PREFIXES = (4, 5, 6, 7, 8)
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3


def terms(flat: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(term, document), distinct and ordered by document, of the documents lo..hi-1."""
    w = Words(flat, bounds, lo, hi, LETTERS)
    doc, size = w.doc_of(), w.ends - w.starts
    found, at = [w.span_hash(w.starts, w.ends, LOWER_CODE)], [doc]
    for n in PREFIXES:
        long = size > n
        found.append(w.span_hash(w.starts[long], w.starts[long] + n, LOWER_CODE) ^ _U(n << 40))
        at.append(doc[long])
    key = np.unique(np.concatenate(at).astype(_U) << _U(28) | np.concatenate(found) >> _U(36))
    return (key & _U((1 << 28) - 1)).astype(np.int32), (key >> _U(28)).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bounds = text_buffers(batch.column(0))
        for lo, hi in chunks(bounds):
            t, d = terms(flat, bounds, lo, hi)
            offsets = np.r_[0, np.cumsum(np.bincount(d, minlength=hi - lo))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(t)), batch.column(1).slice(lo, hi - lo)], ["ids", "label"])


def _paired(which: np.ndarray, doc: np.ndarray, df: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The terms that stand in pairs whose share of toxic documents isn't explained by the two terms' own shares."""
    common = np.argsort(-np.where(2 * df <= len(label), df, 0), kind="stable")[:PAIRED]
    common = common[(df[common] >= EVER) & (2 * df[common] <= len(label))]
    place = np.full(len(df), -1)
    place[common] = np.arange(len(common))
    use = place[which] >= 0
    has = np.zeros((len(label), len(common)), np.float32)
    has[doc[use], place[which[use]]] = 1
    both, toxic = has.T @ has, has[label == 1].T @ has[label == 1]
    share = _share(label)
    odds = np.log(share / (1 - share))
    size, own = np.diag(both), (np.diag(toxic) + 2 * share) / (np.diag(both) + 2)
    rise = np.log(own / (1 - own)) - odds
    expected = 1 / (1 + np.exp(-(odds + rise[:, None] + rise[None, :])))
    surprise = np.abs(toxic - both * expected) / np.sqrt(both * expected * (1 - expected) + 1e-9)
    surprise[(both < EVER) | (both >= 0.8 * np.minimum(size[:, None], size[None, :]))] = 0  # a word and its own prefix are no pair
    return common[(surprise >= PAIR_DEVIATIONS).any(1)]


def _share(label: np.ndarray) -> float:
    return min(0.99, max(0.01, float(np.mean(label))))


def machine(ids: list[np.ndarray], label: np.ndarray, n: int, order: np.ndarray, factors: int = FACTORS) -> tuple[np.ndarray, np.ndarray, float]:
    """AdaGrad over documents of term numbers below ``n``: weights, factors and bias."""
    rng = np.random.default_rng(11)
    w, v = np.zeros(n, np.float32), rng.normal(0, FIRST, (n, factors)).astype(np.float32)
    gw, gv = np.full(n, 1e-2, np.float32), np.full((n, factors), 1e-2, np.float32)
    share = _share(label)
    w0 = float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            x = ids[i]
            wi, vi = w[x], v[x]
            s = vi.sum(0)
            z = w0 + wi.sum() + 0.5 * float((s * s).sum() - (vi * vi).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[i]
            w0 -= 0.01 * g
            dw, dv = g + DECAY * wi, g * (s - vi) + FACTOR_DECAY * vi
            gw[x] += dw * dw
            gv[x] += dv * dv
            w[x] = wi - RATE * dw / np.sqrt(gw[x])
            v[x] = vi - FACTOR_RATE * dv / np.sqrt(gv[x])
    return w, v, w0


def fit(rows: pa.Table, factors: int = FACTORS) -> bytes:
    """Terms, weights, factors and bias from (ids, label), as an npz file."""
    label = rows.column("label").to_numpy()
    raw = [x.values.to_numpy() for x in rows.column("ids")]
    order = np.lexsort((label, [len(x) for x in raw], [int(x[:8].astype(np.int64).sum()) for x in raw]))  # tasks deliver in any order
    names, which, df = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    keep = np.zeros(len(names), bool)
    keep[_paired(which, doc, df, label)] = True
    score = np.full(len(raw), np.log(_share(label) / (1 - _share(label))))
    for k in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        error, spread = label - p, p * (1 - p) + 1e-6
        slope = (score - score.mean()) / (score.std() + 1e-9)
        total = lambda x: np.bincount(which, x[doc], len(names))
        alone = np.abs(total(error)) >= DEVIATIONS * np.sqrt(total(spread))
        rising = np.abs(total(error * slope)) >= DEVIATIONS * np.sqrt(total(spread * slope * slope) + 1e-9) if k else np.zeros(len(names), bool)
        new = keep | ((df >= LEAST) & (alone | rising))
        if k and (new == keep).all():
            break
        keep = new
        use = keep[which]
        number = (np.cumsum(keep) - 1)[which[use]]
        cut = np.searchsorted(doc[use], np.arange(len(raw) + 1))
        ids = [number[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        w, v, w0 = machine(ids, label, int(keep.sum()), order, factors)
        score = np.array([w0 + w[x].sum() + 0.5 * float((v[x].sum(0) ** 2).sum() - (v[x] ** 2).sum()) for x in ids])
    out = io.BytesIO()
    np.savez(out, names=names[keep], w=w, v=v, w0=w0)
    return out.getvalue()


def _score(model: bytes | None):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.load(io.BytesIO(model)) if model else {"names": np.zeros(0, np.int32), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "w0": 0.0}
        names, w0 = m["names"], float(m["w0"])
        table = np.column_stack([m["w"], m["v"], (m["v"] ** 2).sum(1)]).astype(np.float64)
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            scores = np.zeros(batch.num_rows)
            for lo, hi in chunks(bounds):
                t, d = terms(flat, bounds, lo, hi)
                at = np.searchsorted(names, t)
                at[at == len(names)] = 0
                known = names[at] == t if len(names) else np.zeros(len(t), bool)
                at, d = at[known], d[known]
                sums = [np.bincount(d, table[at, k], hi - lo) for k in range(table.shape[1])]
                z = w0 + sums[0] + 0.5 * (sum(s * s for s in sums[1:-1]) - sums[-1])
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return job


def toxicity_scores(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; learns ``labels.toxic`` from the rows that ``use`` admits."""
    prepare(docs.sparkSession)
    docs = documents(docs, "doc_id", "text")
    model = train(labelled_sample(docs, labels, "toxic", use, SAMPLE), _featurise, fit, "ids array<int>, label int")
    out = docs.mapInArrow(_score(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
