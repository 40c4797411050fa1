"""Shapes of tables and arrays: nesting, sequences, interleaving, natural order, edges and centres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.operators.statistics import uniform

MARK = "<--"


def flatten(df: DataFrame, mark: str = MARK) -> DataFrame:
    """Nested structs as columns named ``a<--b<--c``."""

    def leaves(schema: T.StructType, path: list[str]) -> list[list[str]]:
        out = []
        for f in schema.fields:
            out += leaves(f.dataType, [*path, f.name]) if isinstance(f.dataType, T.StructType) else [[*path, f.name]]
        return out

    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(mark.join(p)) for p in leaves(df.schema, [])))


def unflatten(df: DataFrame, mark: str = MARK) -> DataFrame:
    """The inverse of ``flatten``."""

    def build(names: dict[str, str]) -> list[Column]:
        groups: dict[str, dict[str, str]] = {}
        for path, column in names.items():
            head, _, rest = path.partition(mark)
            groups.setdefault(head, {})[rest] = column
        return [F.col(f"`{g['']}`").alias(h) if "" in g else F.struct(*build(g)).alias(h) for h, g in groups.items()]

    return df.select(*build({c: c for c in df.columns}))


def linspace(spark: SparkSession, low: float, high: float, num: int) -> DataFrame:
    """``num`` evenly spaced values, ends included."""
    return spark.range(num).select("id", (low + F.col("id") * ((high - low) / max(num - 1, 1))).alias("value"))


def logspace(spark: SparkSession, low: float, high: float, num: int) -> DataFrame:
    import math

    a, b = math.log10(low), math.log10(high)
    return spark.range(num).select("id", F.pow(F.lit(10.0), a + F.col("id") * ((b - a) / max(num - 1, 1))).alias("value"))


def geomspace(spark: SparkSession, start: float, ratio: float, num: int) -> DataFrame:
    return spark.range(num).select("id", (start * F.pow(F.lit(float(ratio)), F.col("id").cast("double"))).alias("value"))


def spaced(df: DataFrame, low: Column, high: Column, num: int, how: str = "linear", place: str = "id", out: str = "value") -> DataFrame:
    """``num`` rows for each of ``df``, with values from ``low`` to ``high``: evenly spaced, or by even steps of their logarithm."""
    share = F.col(place) / float(max(num - 1, 1))
    a, b = (low, high) if how == "linear" else (F.log10(low), F.log10(high))
    value = a + share * (b - a)
    rows = df.withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num - 1).cast("long"))))
    return rows.withColumn(out, value if how == "linear" else F.pow(F.lit(10.0), value))


def counted(df: DataFrame, count: Column, place: str = "id", most: int = 10_000) -> DataFrame:
    """Each row of ``df`` ``count`` times, numbered from 0; at most ``most`` numbers are made from one row at once."""
    steps = df.withColumn("_count", count.cast("long")).where("_count > 0")
    steps = steps.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(most).cast("long"))))
    return steps.withColumn(place, F.explode(F.sequence("_from", F.least(F.col("_from") + (most - 1), F.col("_count") - 1)))).drop("_count", "_from")


def ticks_between(df: DataFrame, start: str, end: str, step_us: int, out: str = "tick") -> DataFrame:
    """For each row of ``df`` the times from ``start`` by ``step_us`` that are not after ``end``."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = counted(df, F.floor((us(end) - us(start)) / step_us) + 1)
    return rows.withColumn(out, F.timestamp_add("MICROSECOND", F.col("id") * step_us, F.col(start)))


def random_times_between(df: DataFrame, start: str, end: str, count: str, seed: int, out: str = "ts") -> DataFrame:
    """For each row of ``df`` as many times as ``count`` says, spread evenly over [start, end), each from its number and the seed."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = counted(df, F.col(count))
    after = F.floor(uniform(F.col("id"), F.lit(seed)) * (us(end) - us(start))).cast("long")
    return rows.withColumn(out, F.timestamp_add("MICROSECOND", after, F.col(start)))


def natural_key(text: Column) -> Column:
    """Orders digit runs by their number: each run is padded to 20 digits."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(F.lower(x))), "")


def interweave(a: Column, b: Column) -> Column:
    """a0, b0, a1, b1 ... of two arrays of one length."""
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))


def centers_to_edges(centers: Column) -> Column:
    """Edges midway between centres; the outer ones as far out as the next one is in."""
    n = F.size(centers)
    mid = F.zip_with(F.slice(centers, 1, n - 1), F.slice(centers, 2, n - 1), lambda x, y: (x + y) / 2)
    first = 2 * F.get(centers, F.lit(0)) - F.get(mid, F.lit(0))
    last = 2 * F.get(centers, n - 1) - F.get(mid, n - 2)
    return F.concat(F.array(first), mid, F.array(last))


def edges_to_centers(edges: Column) -> Column:
    n = F.size(edges)
    return F.zip_with(F.slice(edges, 1, n - 1), F.slice(edges, 2, n - 1), lambda x, y: (x + y) / 2)


def apply_index(values: Column, index: Column) -> Column:
    """Elements of an array in the order of 0-based indices."""
    return F.transform(index, lambda i: F.get(values, i))


def reverse_index(index: Column) -> Column:
    """The inverse permutation."""
    return F.transform(F.array_sort(F.transform(index, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each stands first."""
    return df.groupBy(value).agg(F.min(order).alias("first"))


def finite_range(df: DataFrame, *columns: str) -> DataFrame:
    """Least and greatest finite value of each column."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.agg(*(f(ok(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def tick_range(spark: SparkSession, start: str, end: str, step_us: int) -> DataFrame:
    """(id, ts): times from ``start`` by ``step``; ``end`` is there if a step meets it."""
    ends = spark.range(1).select(*(F.lit(x).cast("timestamp_ntz").alias(n) for n, x in (("a", start), ("b", end))))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    count = ends.select(F.floor((us("b") - us("a")) / F.lit(step_us)) + 1).first()[0]
    return spark.range(max(count, 0)).select("id", F.timestamp_add("MICROSECOND", F.col("id") * step_us, F.lit(start).cast("timestamp_ntz")).alias("ts"))


def random_times(spark: SparkSession, start: str, end: str, count: int, seed: int) -> DataFrame:
    """(id, ts): ``count`` times spread evenly over [start, end), each from its number and the seed."""
    a, b = (F.unix_micros(F.lit(x).cast("timestamp_ntz").cast("timestamp")) for x in (start, end))
    share = uniform(F.col("id"), F.lit(seed))
    return spark.range(count).select("id", F.timestamp_add("MICROSECOND", F.floor(share * (b - a)).cast("long"), F.lit(start).cast("timestamp_ntz")).alias("ts"))


def flat_index(position: Column, index: Column, size: int) -> Column:
    """Place in the flattened array of ``index`` on the last axis of ``size``, at row ``position``."""
    return position * size + index


def axis_index(position: Column, shape: tuple[int, ...], axis: int = -1) -> Column:
    """Index along one axis of the element at ``position`` of a flattened array of ``shape``."""
    axis %= len(shape)
    below = 1
    for n in shape[axis + 1 :]:
        below *= n
    return F.pmod(F.floor(position / below), F.lit(shape[axis])).cast("long")


def side_by_side(*arrays: Column) -> Column:
    """The arrays of a row one after another: columns beside columns."""
    return F.concat(*arrays)


def in_depth(*arrays: Column) -> Column:
    """One array of the values at each place: layers behind layers."""
    return F.transform(F.sequence(F.lit(0), F.size(arrays[0]) - 1), lambda i: F.array(*(F.get(a, i) for a in arrays)))


def labelled(df: DataFrame, values: str, labels: list[str], keep: tuple[str, ...], valid: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """An array column as one column for each label, each value passed through ``valid``; ``keep`` are the record's own columns."""
    return df.select(*keep, *(valid(F.get(values, F.lit(k))).alias(n) for k, n in enumerate(labels)))


def bundled(df: DataFrame, columns: list[str], fill: float, out: str = "data") -> DataFrame:
    """The inverse: columns as one array, nulls and NaN as ``fill``; the labels go to the column's metadata."""
    values = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fill)) for c in columns))
    return df.select(*(c for c in df.columns if c not in columns), values.alias(out, metadata={"LABELS": columns, "FILLVAL": fill}))
