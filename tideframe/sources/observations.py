"""A table of observations kept by satellite, invariants and day, whose listings are answered from the partitions' names.

Phase-space densities and the like are asked for by a few exact values and a range of time. These values are the names of
the partitions, so a listing opens no file, and a range reads the files of the wanted values and days alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("satellite", "mu", "k")


def write_observations(df: DataFrame, path: str, ts: str = "ts", names: tuple[str, ...] = NAMES) -> None:
    """Write ``df`` below ``path``, partitioned by ``names`` and the day of ``ts``; rows without a time or a name's value are left out."""
    known = df.where(" and ".join(f"{c} is not null" for c in (*names, ts))).withColumn("day", F.col(ts).cast("date"))
    known.repartition(*names, "day").sortWithinPartitions(ts).write.partitionBy(*names, "day").parquet(path)


def _named(c: str) -> Column:
    """A partition's value as its folder is named."""
    raw = F.regexp_extract("path", f"/{c}=([^/]*)", 1)
    return F.url_decode(F.regexp_replace(raw, r"\+", "%2B")).alias(c)


def listing(spark: SparkSession, path: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(names, day) of all partitions as texts, from the files' paths; their content is not touched."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(*map(_named, (*names, "day"))).distinct()


def available(spark: SparkSession, path: str, what: str, start: dt.datetime | None = None, stop: dt.datetime | None = None, equal: dict[str, str] | None = None) -> DataFrame:
    """The distinct values of one name among the partitions whose days meet the range and whose other names are as said."""
    rows = listing(spark, path)
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start.date().isoformat()))
    if stop is not None:
        rows = rows.where(F.col("day") <= F.lit(stop.date().isoformat()))
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == value)
    return rows.select(what).distinct()


def observations(spark: SparkSession, path: str, mu: float, k: float, start: dt.datetime, stop: dt.datetime, satellites: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Rows strictly between two times at one pair of invariants, of the ``satellites`` named (all if none are)."""
    rows = spark.read.parquet(path)
    rows = rows.where((F.col("mu") == mu) & (F.col("k") == k) & F.col("day").between(F.lit(start.date()), F.lit(stop.date())))
    kind = rows.schema[ts].dataType
    rows = rows.where((F.col(ts) > F.lit(start).cast(kind)) & (F.col(ts) < F.lit(stop).cast(kind)))
    if satellites is not None:
        rows = rows.where(F.col("satellite").cast("string").isin(satellites))
    return rows.drop("day")
