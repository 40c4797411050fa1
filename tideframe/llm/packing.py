"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program covers the histogram with as few
configurations as it can. It is solved by multiplicative weights: each round prices the lengths, a knapsack dynamic
program finds the configuration worth most, it is used as far as its scarcest length allows, and the lengths it covers
lose weight. The fractional solution is rounded down; what is left over is packed largest first, each sequence filled by
the best subset of the remaining lengths. The histogram has as many entries as a sequence has tokens, whatever the
table's size, so this part is a small computation on the driver.

Jobs: (1) a map tokenizes every whole text and gives its pieces with their place among the equal lengths of their task;
this is stored; (2) pre-aggregated counts by length, and by task and length, give each piece a rank among all of its
length without sorting them; (3) a join with the (bounded, broadcast) table of rank ranges places every piece.

Defined results: null or empty text is the end id alone; repeated rows are packed each for itself; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.shared import documents, prepare, stored

#: Rounds of multiplicative weights and the share of its weight that a fully covered length loses.
ROUNDS, LOSS = 400, 0.5
_tokenizers: dict[str, tuple] = {}


def tokenizer(path: str) -> tuple:
    """(fast encoder, exact encoder, texts of added tokens) of a byte-level BPE file, loaded once in each Python process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        _tokenizers[path] = (_ranked(path), slow, [x.content for x in slow.get_added_tokens_decoder().values()])
    return _tokenizers[path]


def _ranked(path: str):
    """The same vocabulary and pattern for the faster library, if the rank file is beside the tokenizer's."""
    import os

    import public_tokenizers
    import tiktoken

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text. Only texts without added tokens, of code points that both libraries class alike, go to the faster one."""
    fast, slow, added = tokenizer(path)
    if fast is not None and (text.isascii() or max(text) < " ") and not any(c in text for c in "\x1c\x1d\x1e\x1f\x85") and not any(x in text for x in added):
        return np.array(fast.encode_ordinary(text), np.uint32)
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(path: str, size: int, end: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", path), np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                start = 0
                for k, stop in enumerate(range(first, len(ids) + 1, size)):
                    n = stop - start
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    start = stop
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return job


def knapsack(worth: np.ndarray, size: int) -> dict[int, int]:
    """The configuration of the largest worth: length to count, lengths in all at most ``size``."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    values = worth[1:]
    for c in range(1, size + 1):
        gain = values[:c] + best[c - 1 :: -1] if c > 1 else values[:1] + best[:1]
        k = int(np.argmax(gain))
        best[c], took[c] = best[c - 1], 0
        if gain[k] > best[c] + 1e-15:
            best[c], took[c] = gain[k], k + 1
    out: dict[int, int] = {}
    c = size
    while c > 0:
        if took[c]:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return out


def fractional(counts: np.ndarray, size: int) -> dict[tuple, float]:
    """Configurations and how often to use each, from multiplicative weights on the covering program."""
    have = counts > 0
    weight = np.zeros(size + 1)
    weight[have] = np.flatnonzero(have) / size
    used: dict[tuple, float] = {}
    for _ in range(ROUNDS if have.any() else 0):
        config = knapsack(weight, size)
        if not config:
            break
        step = min(counts[n] / m for n, m in config.items())
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + step
        for n, m in config.items():
            weight[n] *= (1 - LOSS) ** (step * m / counts[n])
    return used


def fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """The lengths that fill ``room`` best, of those left, by subset sums with multiplicities."""
    reach, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n in left if n <= room), reverse=True):
        copies, k = min(left[n], room // n), 1
        while copies:
            k = min(k, copies)
            new = (reach | reach << (n * k)) & mask
            if new != reach:
                stages.append((n, k, reach))
                reach = new
            copies -= k
            k *= 2
        if reach >> room & 1:
            break
    c, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(stages):
        if not before >> c & 1:
            out[n] = out.get(n, 0) + k
            c -= n * k
    return out


def plan(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, copies) that hold exactly the ``counts`` of the lengths 1 ... size."""
    left = {n: int(c) for n, c in enumerate(counts) if c}
    out = []
    if full := left.pop(size, 0):
        out.append(({size: 1}, full))
    rest = counts.astype(float).copy()
    rest[size] = 0
    used = fractional(rest, size)
    # the rounds cover each length several times over; scaled to once, then rounded down, least waste first
    total = np.zeros(size + 1)
    for config, x in used.items():
        for n, m in config:
            total[n] += m * x
    scale = min((rest[n] / total[n] for n in np.flatnonzero(total)), default=0.0)
    for config, x in sorted(used.items(), key=lambda p: (size - sum(n * m for n, m in p[0]), p[0])):
        copies = min([int(x * scale), *(left.get(n, 0) // m for n, m in config)])
        if copies > 0:
            out.append((dict(config), copies))
            for n, m in config:
                left[n] -= m * copies
    left = {n: c for n, c in left.items() if c}
    while left:
        first = max(left)
        left[first] -= 1
        config = fill(size - first, {n: c for n, c in left.items() if c})
        config[first] = config.get(first, 0) + 1
        left[first] += 1
        copies = min(left[n] // m for n, m in config.items())
        out.append((config, copies))
        for n, m in config.items():
            left[n] -= m * copies
        left = {n: c for n, c in left.items() if c}
    return out


def _ranges(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of this length in a sequence, offset of the first)."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for config, copies in plans:
        offset = 0
        for n, m in sorted(config.items(), reverse=True):
            r = rank.get(n, 0)
            out.append((n, r, r + m * copies, sequence, m, offset))
            rank[n] = r + m * copies
            offset += n * m
        sequence += copies
    return out


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs`` (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = stored(documents(docs, "doc_id", "text").mapInArrow(_pieces(path, size, end), schema), "pieces")
    by_part = pieces.groupBy("length", "part").count()
    counts = np.zeros(size + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    ranges = _ranges(plan(counts, size))  # at most a few thousand rows
    table = spark.createDataFrame(ranges or [(0, 0, 0, 0, 1, 0)], "n long, low long, high long, first long, many long, place long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    turn = F.col("rank") - F.col("low")
    sequence = (F.col("first") + F.floor(turn / F.col("many"))).cast("long").alias("sequence_id")
    offset = (F.col("place") + F.pmod(turn, F.col("many")) * F.col("length")).cast("long").alias("offset")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, offset)
