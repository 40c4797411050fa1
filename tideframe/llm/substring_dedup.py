"""Substring dedup by level-wise doubling.

A window is ``length`` consecutive words of one document. Words covered by a window whose word sequence also starts in
a document with a smaller id are removed; windows are judged on the input.

Levels. Window lengths double from FIRST words or more to ``length``: 12, 25, 50. Only windows repeated in another document
at one level are extended to the next; it ends early when none survives. Below the last level not all windows are counted
but the content-defined ones: in each window that the next level would count, the one of the smallest hash, so that every
repeated window of ``length`` words holds a counted one at each level, wherever it stands. Windows of the last level carry
128 bits of hash; the smallest document id for each of them decides.

Jobs, for each level: (1) a map over the texts that still have survivors gives their windows of this level; (2) a partly
pre-aggregated grouping finds the repeated ones with their smallest document, and a join brings these back; keys that hold
more than their share of the rows are split in it over many tasks. Then (3) runs of covered words meet the texts again.

Defined results: null or empty text has no words and keeps an empty text; documents under ``length`` words lose
nothing; rows without a ``doc_id`` lose nothing and remove nothing; repeats inside one document alone are kept; equal rows of one ``doc_id`` never remove each other; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import BROADCAST_BYTES, documents, prepare, stored, with_owner
from tideframe.llm.textops import Words, chunks, mix, pair, text_buffers

_U = np.uint64
#: Least words of a window at the first level.
FIRST = 12


def window_hash(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``n`` words in one run of word hashes, by doubling; windows over the end are missing."""
    have, size, out, done, k = words, 1, None, 0, salt
    while True:
        if n & size:
            out, done = (have, size) if out is None else (pair(out[: max(0, len(out) - size)], have[done:], k + 13), done + size)
        if size * 2 > n:
            return out[: max(0, len(words) - n + 1)]
        have = pair(have[: max(0, len(have) - size)], have[size:], k)
        size, k = size * 2, k + 1


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return x if size == n else best(x[: len(x) - (n - size)], x[n - size :])


def lengths(length: int) -> list[int]:
    """Window lengths of the levels: ``length`` and its halves down to FIRST words or more."""
    out = [length]
    while len(out) < 2 or out[0] // 2 >= FIRST:
        out.insert(0, out[0] // 2)
    return out


class _Levels:
    """The windows of a chunk of documents laid out flat; windows across two documents are masked.

    ``at[k]`` are the counted window starts of level k, ``low[k]`` the smallest level-k hash within each level k + 1 window.
    """

    def __init__(self, flat, bounds, lo, hi, sizes):
        self.words = w = Words(flat, bounds, lo, hi)
        self.hash = h = w.hashes()
        self.first, self.doc = w.first, w.doc_of()
        length = sizes[-1]
        whole = np.zeros(0, bool) if len(h) < length else self.doc[: len(h) - length + 1] == self.doc[length - 1 :]
        self.hashes: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.at = [np.flatnonzero(whole)]
        if not len(self.at[0]):
            return
        for n, above in zip(sizes[:-1], sizes[1:], strict=True):
            self.hashes.append(window_hash(h, n))
            self.low.append(_sliding(self.hashes[-1], above - n + 1, np.minimum))
        for k in range(len(sizes) - 2, -1, -1):
            self.at.insert(0, self._smallest(k, sizes[k + 1] - sizes[k] + 1))

    def _smallest(self, k: int, span: int) -> np.ndarray:
        """Starts of the level-k windows that are the smallest in some counted window of the level above."""
        above, h, n = self.at[0], self.hashes[k], len(self.hashes[k])
        if len(above) * 4 < n:
            spots = above[:, None] + np.arange(span)
            return np.unique(spots[h[spots] == self.low[k][above][:, None]])
        low = np.zeros(n + span - 1, _U)
        low[span - 1 + above] = self.low[k][above]
        # the largest of the minima of the windows above that hold this one
        held = np.zeros(n + span, np.int64)
        np.add.at(held, above, 1)
        np.add.at(held, above + span, -1)
        return np.flatnonzero((np.cumsum(held[:n]) > 0) & (h == _sliding(np.r_[low, np.zeros(span, _U)], span, np.maximum)[:n]))


def _alive(keys: np.ndarray, docs: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which keys' 32 low bits stand in the list of their document."""
    sizes = np.diff(lists.offsets.to_numpy())
    salt = mix(np.arange(len(sizes), dtype=_U) + _U(77))
    keep = np.sort(mix((lists.flatten().to_numpy().astype(np.int64) + (1 << 31)).view(_U) + np.repeat(salt, sizes)))
    if not len(keep):
        return np.zeros(len(keys), bool)
    key = mix((keys & _U(0xFFFFFFFF)) + salt[docs])
    return keep[np.minimum(np.searchsorted(keep, key), len(keep) - 1)] == key


def _windows(sizes: list[int], level: int):
    """(doc_id, text) and above the first level also the survivors of the level below, to the windows of ``level``."""
    last = level == len(sizes) - 1

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(bounds):
                x = _Levels(flat, bounds, lo, hi, sizes)
                at = x.at[level] if x.low else x.at[0]
                if level and len(at):
                    at = at[_alive(x.low[level - 1][at], x.doc[at], batch.column(2).slice(lo, hi - lo))]
                if not len(at):
                    continue
                d = x.doc[at]
                if last:
                    a, b = window_hash(x.hash, sizes[-1])[at], window_hash(x.hash, sizes[-1], 7)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids[lo:hi][d]), pa.array((at - x.first[d]).astype(np.int32))], ["a", "b", "doc_id", "pos"])
                    continue
                h = x.hashes[level][at]
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[lo:hi][d[new]])], ["h", "doc_id"])

    return job


def _runs(length: int):
    """Window starts of a document to runs of covered words, as (first, last + 1) pairs."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column(1):
                s = np.unique(starts.values.to_numpy())
                cut = np.flatnonzero(np.diff(s) > length)
                out.append(np.stack([s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + length], 1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "runs"])

    return job


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs, carried columns) to the word counts and the kept words joined by one space."""
    for batch in batches:
        flat, bounds = text_buffers(batch.column(1))
        runs = batch.column(2)
        n_words, n_removed, kept = [], [], []
        for lo, hi in chunks(bounds):
            w = Words(flat, bounds, lo, hi)
            for i in range(hi - lo):
                a, n = w.first[i], w.counts[i]
                r = runs[lo + i].values
                alive = np.ones(n, bool)
                if r is not None:
                    for s, e in r.to_numpy().reshape(-1, 2):
                        alive[s:e] = False
                n_words.append(int(n))
                n_removed.append(int(n - alive.sum()))
                words = w.bytes[w.edges[i] : w.edges[i + 1]].tobytes().split()
                kept.append(b" ".join(words if r is None else [x for x, ok in zip(words, alive, strict=True) if ok]))
        carried = [batch.column(k) for k in range(3, batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *carried],
            ["doc_id", "n_words", "n_removed", "kept_text", *batch.schema.names[3:]],
        )


def covered_runs(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, runs): the words to remove as flat (first, last + 1) pairs, for the documents that lose some."""
    if length < 2:
        raise ValueError("length must be 2 words or more")
    prepare(docs.sparkSession)
    docs = documents(docs, "doc_id", "text").where("doc_id is not null")
    sizes, rows = lengths(length), docs
    short = (F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")
    for level in range(len(sizes) - 1):
        counted = stored(rows.mapInArrow(_windows(sizes, level), "h long, doc_id long"), "counted-windows")
        alive = with_owner(counted, ["h"], "doc_id").groupBy("doc_id").agg(F.collect_list(short).alias("alive"))
        alive = stored(alive, "surviving-windows")
        if alive.isEmpty():
            return alive.select("doc_id", F.col("alive").alias("runs"))
        rows = _beside(docs, alive, "alive")
    windows = rows.mapInArrow(_windows(sizes, len(sizes) - 1), "a long, b long, doc_id long, pos int")
    removed = with_owner(windows, ["a", "b"], "doc_id", "pos").where("owner < doc_id")
    return removed.groupBy("doc_id").agg(F.collect_list("pos").alias("pos")).mapInArrow(_runs(length), "doc_id long, runs array<int>")


def _beside(docs: DataFrame, lists: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Join lists of integers to their documents: broadcast if their bytes in the built relation fit the limit, else shuffled."""
    size = lists.select(F.sum(F.size(column) * 4 + 96)).first()[0] or 0
    return docs.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "doc_id", how)


def remove_repeats(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) and the ``carry`` columns of every row of ``docs`` (``doc_id``, ``text``)."""
    runs = stored(covered_runs(docs, length), "runs")
    rows = _beside(documents(docs, "doc_id", "text", *(F.col(c).alias(f"_{c}") for c in carry)), runs, "runs", "left")
    rows = rows.select("doc_id", "text", "runs", *(f"_{c}" for c in carry))
    more = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = rows.mapInArrow(_rest, f"doc_id long, n_words long, n_removed long, kept_text string{more}")
    return out.withColumnsRenamed({f"_{c}": c for c in carry})
