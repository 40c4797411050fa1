"""Stored arrays: one row a chunk, with an index of chunk positions, and hyperslices that read only the chunks they touch.

An array of any number of dimensions is cut into chunks of one shape; a chunk's row has its position along every dimension
(``c0``, ``c1``, ...), its extent (``n0``, ...) and its values in row-major order. A hyperslice (numbers, ranges with steps in
either direction, an ellipsis) becomes conditions on the positions, which Parquet's statistics prune, and then the offsets
inside each chunk that it selects; dimensions indexed by a number go.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunk positions along one dimension that are listed; more are bounded by a range and told apart by their remainders.
LISTED = 200

Key = int | slice | type(Ellipsis)


@dataclass(frozen=True)
class Along:
    """What a slice takes along one dimension: ``count`` elements from ``start``, each ``step`` (either sign) after the last."""

    start: int
    step: int
    count: int
    dropped: bool = False

    @property
    def low(self) -> int:
        return min(self.start, self.start + self.step * (self.count - 1))

    @property
    def high(self) -> int:
        return max(self.start, self.start + self.step * (self.count - 1))


def selection(key: Key | tuple[Key, ...], shape: tuple[int, ...]) -> list[Along]:
    """The meaning of an index for an array of this shape; IndexError for numbers outside, too many indices or two ellipses."""
    keys = key if isinstance(key, tuple) else (key,)
    if sum(k is Ellipsis for k in keys) > 1:
        raise IndexError("one ellipsis at most")
    if Ellipsis not in keys:
        keys = (*keys, Ellipsis)
    at = keys.index(Ellipsis)
    missing = len(shape) - len(keys) + 1
    if missing < 0:
        raise IndexError(f"{len(keys) - 1} indices for {len(shape)} dimensions")
    keys = keys[:at] + (slice(None),) * missing + keys[at + 1 :]
    out = []
    for k, n in zip(keys, shape, strict=True):
        if isinstance(k, slice):
            start, stop, step = k.indices(n)
            out.append(Along(start, step, len(range(start, stop, step))))
        elif -n <= k < n:
            out.append(Along(k % n, 1, 1, True))
        else:
            raise IndexError(f"{k} is outside of a dimension of {n}")
    return out


def write_array(cells: DataFrame, path: str, chunk: tuple[int, ...], value: str = "value") -> None:
    """Write ``cells`` (i0, i1, ..., value) as chunks of at most ``chunk`` elements along each dimension, in files sorted by position.

    The array is as large as the largest indices say; cells without a row are null. A chunk is one row, so its size is what
    a task holds.
    """
    dims = range(len(chunk))
    shape = cells.agg(*(F.max(f"i{d}") for d in dims)).first()
    shape = [0 if n is None else n + 1 for n in shape]
    at = [F.floor(F.col(f"i{d}") / c).cast("long").alias(f"c{d}") for d, c in enumerate(chunk)]
    extent = [F.least(F.lit(c), F.lit(n) - F.col(f"c{d}") * c).cast("int").alias(f"n{d}") for d, (c, n) in enumerate(zip(chunk, shape, strict=True))]
    place = F.lit(0)
    for d in dims:
        place = place * F.col(f"n{d}") + F.col(f"i{d}") - F.col(f"c{d}") * chunk[d]
    rows = cells.select("*", *at).select("*", *extent).withColumn("_p", place.cast("int"))
    names = [f"{x}{d}" for x in "cn" for d in dims]
    size = math.prod(chunk)
    rows = rows.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_p", F.col(value)))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), _product([F.col(f"n{d}") for d in dims]) - 1), lambda k: F.element_at("_m", k)).alias("values")
    rows = rows.select(*names, *(F.lit(n).cast("long").alias(f"shape{d}") for d, n in enumerate(shape)), *(F.lit(c).alias(f"chunk{d}") for d, c in enumerate(chunk)), values)
    rows.repartitionByRange(*(f"c{d}" for d in dims)).sortWithinPartitions(*(f"c{d}" for d in dims)).write.option("parquet.block.size", max(1 << 20, 64 * size)).parquet(path)


def _product(columns: list[Column]) -> Column:
    out = F.lit(1)
    for c in columns:
        out = out * c
    return out.cast("int")


def _touched(c: Column, a: Along, chunk: int) -> Column:
    """Condition on chunk positions along a dimension: those that hold an element the slice takes."""
    low, high = a.low // chunk, a.high // chunk
    inside = (c >= low) & (c <= high)
    if abs(a.step) <= chunk:
        return inside
    found = sorted({(a.low + abs(a.step) * k) // chunk for k in range(min(a.count, LISTED + 1))})
    if a.count <= LISTED:
        return c.isin(found) & inside
    # the first selected element at or after the chunk's begin lies in the chunk
    return inside & (F.pmod(a.low - c * chunk, F.lit(abs(a.step))) < chunk)


def hyperslice(spark: SparkSession, path: str, key: Key | tuple[Key, ...]) -> DataFrame:
    """(i0, i1, ..., value) of the elements that ``key`` takes, numbered anew from 0 along each dimension that is left.

    Elements nobody wrote are null. An empty slice gives no rows; so does an array without cells.
    """
    chunks = spark.read.parquet(path)
    dims = sum(c.startswith("chunk") for c in chunks.columns)
    first = chunks.select(*(f"shape{d}" for d in range(dims)), *(f"chunk{d}" for d in range(dims))).first()
    shape, size = (tuple(first[:dims]), tuple(first[dims:])) if first else ((0,) * dims, (1,) * dims)
    if not first:
        key = tuple(slice(None) for _ in range(dims))
    taken = selection(key, shape)
    for d, a in enumerate(taken):
        chunks = chunks.where(_touched(F.col(f"c{d}"), a, size[d]) if a.count else F.lit(False))
    place, offset = [], F.lit(0)
    for d, a in enumerate(taken):
        begin, step = F.col(f"c{d}") * size[d], abs(a.step)
        low = F.greatest(begin, F.lit(a.low))
        low = low + F.pmod(a.low - low, F.lit(step))  # first selected element in the chunk
        high = F.least(begin + F.col(f"n{d}") - 1, F.lit(a.high))
        chunks = chunks.withColumn(f"_e{d}", F.explode(F.when(low <= high, F.sequence(low, high, F.lit(step).cast("long")))))
        offset = offset * F.col(f"n{d}") + F.col(f"_e{d}") - begin
        if not a.dropped:
            place.append(((F.col(f"_e{d}") - a.start) / a.step).cast("long").alias(f"i{len(place)}"))
    return chunks.select(*place, F.get("values", offset.cast("int")).alias("value"))


#: Public type names by what they hold: least and greatest whole number, in order of size, signed ones first.
WHOLE = (("INT1", -(2**7), 2**7 - 1), ("UINT1", 0, 2**8 - 1), ("INT2", -(2**15), 2**15 - 1), ("UINT2", 0, 2**16 - 1), ("INT4", -(2**31), 2**31 - 1), ("UINT4", 0, 2**32 - 1), ("INT8", -(2**63), 2**63 - 1))
#: Absolute values that four-byte numbers hold in every encoding.
FLOAT_LOW, FLOAT_HIGH = 3e-39, 1.7e38


def fitting_types(df: DataFrame) -> dict[str, tuple[list[str], int]]:
    """For each column, the stored types that hold all its values, the best first, and the elements a value needs.

    Whole numbers fit integers by range and then numbers with fractions; others four-byte numbers unless very large or very
    small ones occur; texts need the bytes of their longest; times are kept to a nanosecond (TIME_TT2000), then to a
    millisecond if none has a finer part (EPOCH before EPOCH16). Columns without values fit every type of their kind.
    """
    kinds = {c: "text" if t == "string" else "time" if t.startswith("timestamp") else "number" for c, t in df.dtypes if t in ("string", "float", "double", "tinyint", "smallint", "int", "bigint") or t.startswith(("timestamp", "decimal"))}
    wanted = []
    for c, kind in kinds.items():
        if kind == "text":
            wanted.append(F.max(F.octet_length(c)).alias(c))
        elif kind == "time":
            wanted.append(F.max(F.unix_micros(F.col(c).cast("timestamp")) % 1000 != 0).alias(c))
        else:
            x = F.col(c)
            odd = (F.abs(x.cast("double")) > FLOAT_HIGH) | ((x != 0) & (F.abs(x.cast("double")) < FLOAT_LOW))
            wanted.append(F.struct(F.min(x).alias("low"), F.max(x).alias("high"), F.max(F.isnan(x.cast("double")) | (x != F.floor(x))).alias("parts"), F.max(odd).alias("odd")).alias(c))
    found = df.agg(*wanted).first() if wanted else {}
    out = {}
    for c, kind in kinds.items():
        x = found[c]
        if kind == "text":
            out[c] = (["CHAR", "UCHAR"], max(1, x or 0))
        elif kind == "time":
            out[c] = (["TIME_TT2000", "EPOCH16", "EPOCH"] if x else ["TIME_TT2000", "EPOCH", "EPOCH16"], 1)
        else:
            whole = [] if x["parts"] else [n for n, low, high in WHOLE if x["low"] is None or low <= x["low"] and x["high"] <= high]
            out[c] = (whole + (["DOUBLE"] if x["odd"] else ["FLOAT", "DOUBLE"]), 1)
    return out
