"""Spelling variants of a corpus vocabulary: words one edit apart, and the common form that rare ones are variants of.

Two words one edit apart share all but one segment of the shorter one, wherever it is cut. Every word stands in a bucket
for each half of its own length and for each half of one letter less (where it would be the longer word of a pair); the
bucket's key is all but that half. In a bucket the words' middles are sorted and scanned by banded edit-distance rows: the
rows of a candidate are kept up to the length it shares with the next one, and where all cells of a row exceed one edit
the whole range that shares this prefix is skipped. Each pair is found in one bucket alone: the one whose segment holds
its last possible place of the edit. Buckets of more than LIMIT words are cut anew: their segment is halved and the other
half goes into the key, until they are small or the segment is one letter, so hot prefixes are never compared whole.

Jobs: one map counts words (bounded tables, flushed when full) and one shuffle adds the counts; the vocabulary is stored.
One shuffle deals the buckets, whose words give counts and best neighbours pre-aggregated; one shuffle adds these by word.
Forms are followed by pointer doubling; a form has several times its variant's count, so chains are short.

Defined results: null texts have no words; a null ``doc_id`` is written as nothing; rows that repeat an id count each;
equal counts are decided by code points; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import prepare, small, stored

#: Runs of A-Z, a-z and U+00C0 to U+00FF in the UTF-8 bytes of a text whose A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
#: Words that a counting task holds before it hands them on.
HELD = 200_000
#: Words of a bucket beyond which its segment is halved.
LIMIT = 4096
#: Between the parts of a bucket's key; words are letters alone.
BAR = "\x01"
#: Buckets from this size find the end of a skipped range by bisection.
LARGE = 24


def counted(least: int, typos: int | None):
    """Batches of (doc_id as text, text) to partial counts of words whose runs have ``least`` bytes or more."""

    def flushed(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                begun = crc32(f"{doc.as_py()}:".encode())
                for run, n in Counter(RUN.findall(text.as_py().encode().lower())).items():
                    if len(run) < least:
                        continue
                    if typos and (h := crc32(run, begun)) % typos == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    held[run] = held.get(run, 0) + n
                if len(held) >= HELD:
                    yield flushed(held)
        if held:
            yield flushed(held)

    return job


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, typos: int | None = None) -> DataFrame:
    """(word, n) of the words of ``docs`` with so many code points and occurrences.

    With ``typos``, a run loses one code point in the documents where the checksum of ``doc_id:run`` is divisible by it.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    parts = texts.mapInArrow(counted(least_length, typos), "word string, n long")
    return parts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cut(rows: DataFrame, segments: str) -> DataFrame:
    """Members (key, mid, n) of ``rows`` (word, n, m) for each of the ``segments``, an SQL array of (a, b)."""
    rows = rows.select("word", "n", "m", F.length("word").alias("l"), F.expr(f"inline({segments})"))
    tail = F.expr("substring(word, l - (m - b) + 1, m - b)")
    key = F.concat(F.expr("substring(word, 1, a)"), F.lit(BAR), tail, F.lit(BAR), F.col("m").cast("string"))
    return rows.select(key.alias("key"), F.expr("substring(word, a + 1, l - (m - b) - a)").alias("mid"), "n")


def members(words: DataFrame, least_length: int, limit: int = LIMIT) -> DataFrame:
    """Bucket members (key, mid, n) of every word, in buckets of at most ``limit`` words or of one-letter segments."""
    bases = words.select("word", "n", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), m -> m >= {least_length})")).alias("m"))
    rows = _cut(bases, _halves("0", "m"))
    while True:
        part = F.split("key", BAR)
        width = part[2].cast("int") - F.length(part[0]) - F.length(part[1])
        hot = stored(rows.groupBy("key").count().where((F.col("count") > limit) & (width > 1)).select("key"), "crowded-buckets")
        if hot.isEmpty():
            return rows
        hot = small(hot, 64)
        again = rows.join(hot, "key", "left_semi").select(F.concat(part[0], "mid", part[1]).alias("word"), "n", part[2].cast("int").alias("m"), F.length(part[0]).alias("low"), F.length(part[1]).alias("tail"))
        rows = stored(rows.join(hot, "key", "left_anti").unionByName(_cut(again, _halves("low", "(m - tail)"))), "bucket-members")


def _halves(a: str, b: str) -> str:
    """SQL array of the two halves of a segment."""
    return f"array(struct({a} AS a, ({a} + {b}) div 2 AS b), struct(({a} + {b}) div 2 AS a, {b} AS b))"


def shared_prefixes(words: list[str]) -> list[int]:
    """For each of the sorted words, the letters it shares with the one before."""
    out, before = [], ""
    for w in words:
        k = 0
        for x, y in zip(before, w, strict=False):
            if x != y:
                break
            k += 1
        out.append(k)
        before = w
    return out


def near_in(words: list[str], base: int, last: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of sorted distinct ``words`` of ``base`` or base + 1 letters that are exactly one edit apart.

    Pairs of two longer words belong to another bucket, and so does an insertion behind the whole shorter word unless this
    is the ``last`` segment. Rows of the edit matrix hold the three cells around the diagonal, for a prefix of a candidate
    against the query's prefixes of one letter less, as many and one more.
    """
    n, lcp = len(words), shared_prefixes(words)
    for i in range(n - 1):
        q = words[i]
        size = len(q)
        rows = [(9, 0, 1)]
        j = i + 1
        kept = lcp[j]
        rows += [(1, 0, 1 if d < size else 9) for d in range(1, kept + 1)]  # so far the candidate is the query
        while True:
            w = words[j]
            del rows[kept + 1 :]
            low, mid, high = rows[kept]
            dead = -1
            for d in range(kept, len(w)):
                ch = w[d]
                below = low + (d == 0 or d > size or q[d - 1] != ch)
                low = below if below <= mid else mid + 1
                if d < size:
                    mid = mid + (q[d] != ch)
                    if high < mid:
                        mid = high + 1
                    if low < mid:
                        mid = low + 1
                    if d + 1 < size:
                        high = high + (q[d + 1] != ch)
                        if mid < high:
                            high = mid + 1
                    else:
                        high = 9
                else:
                    mid = high = 9
                if low > 1 and mid > 1 and high > 1:
                    dead = d
                    break
                rows.append((low, mid, high))
            if dead < 0:
                gap = size - len(w)
                if gap == 0:
                    if mid == 1 and size == base:
                        yield i, j
                elif (low if gap == -1 else high if gap == 1 else 9) == 1:
                    short, long = (q, w) if gap < 0 else (w, q)
                    if last or not long.startswith(short):
                        yield i, j
                j += 1
            elif n > LARGE:
                j = bisect_left(words, w[: dead + 1] + "\U0010ffff", j + 1)
            else:
                j += 1
                while j < n and lcp[j] > dead:
                    j += 1
            if j >= n:
                break
            kept = min(lcp[j], len(rows) - 1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, mid, n) sorted by key and mid to (word, near, low, form): neighbours, and the first of (-n, word) among them, in each bucket."""
    key, mids, counts = None, [], []
    out: list[tuple[str, int, int, str]] = []

    def closed() -> None:
        if len(mids) < 2:
            return
        head, tail, m = key.split(BAR)
        near, best = Counter(), {}
        for i, j in near_in(mids, int(m) - len(head) - len(tail), not tail):
            for x, y in ((i, j), (j, i)):
                near[x] += 1
                if x not in best or (-counts[y], mids[y]) < best[x]:
                    best[x] = (-counts[y], mids[y])
        for x, k in near.items():
            out.append((head + mids[x] + tail, k, best[x][0], head + best[x][1] + tail))

    names, kinds = ("word", "near", "low", "form"), (pa.string(), pa.int64(), pa.int64(), pa.string())

    def flushed() -> pa.RecordBatch:
        table = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return table

    for batch in batches:
        for k, mid, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                closed()
                key, mids, counts = k, [], []
            mids.append(mid)
            counts.append(n)
        if len(out) > 5000:
            yield flushed()
    closed()
    if out:
        yield flushed()


def variants(words: DataFrame, least_length: int = 6, times: int = 5, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) whose words have ``least_length`` letters or more.

    ``form`` is the near word of largest count, the first in code-point order of several, if it has ``times`` the word's
    count or more; ``root`` follows the forms to the last.
    """
    words = stored(words, "vocabulary")
    dealt = members(words, least_length, limit).repartition("key").sortWithinPartitions("key", "mid")
    found = dealt.mapInArrow(_neighbours, "word string, near long, low long, form string")
    found = found.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct("low", "form").alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    table = alone.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.low") >= times * F.col("n")
    table = stored(table.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.low")).alias("form_n")), "variants")
    ends = roots(table.where(F.col("form").isNotNull()).select("word", "form"))
    table = table.join(small(ends, 96), "word", "left")
    return table.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles, by pointer doubling."""
    ends = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not ends.where("moved").isEmpty():
        ahead = ends.select(F.col("word").alias("via"), F.col("root").alias("end"))
        ends = ends.join(small(ahead, 96), F.col("root") == F.col("via"), "left")
        ends = stored(ends.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "roots")
    return ends.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, typos: int | None = None) -> DataFrame:
    """``variants`` of the vocabulary of ``docs`` (doc_id, text)."""
    return variants(vocabulary(docs, least_length, least_count, typos), least_length, times)
