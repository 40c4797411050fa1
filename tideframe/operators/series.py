"""Operators on time series: windows, gaps, derivatives, ranks, carried values.

Series are keyed, so that window functions partition; ``carried`` also splits long series of one key by time buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.timescales import from_utc_us, utc_us
from tideframe.storage import stored


def window_mean(df: DataFrame, ts: str, value: str, width_us: int, overlap_us: int = 0, keys: tuple[str, ...] = (), start: Column | None = None, op: Callable[[str], Column] = F.avg) -> DataFrame:
    """(keys, label, value) of windows ``width`` wide that hop by ``width - overlap``.

    Windows start at ``start`` or at the first sample and while they start before the last sample; a window holds the
    samples from its start to just before its end and is labelled by its middle; empty ones are null. Each sample is
    sent to the few windows it is in, so the only shuffle is the aggregation's, with partial results.
    """
    if overlap_us >= width_us:
        raise ValueError("overlap must be shorter than the window")
    hop = width_us - overlap_us
    us = df.select(*keys, utc_us(F.col(ts)).alias("us"), F.col(value).alias("value"))
    ends = us.groupBy(*keys).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    if start is not None:
        ends = ends.withColumn("first", start)
    ends = ends.withColumn("n", F.when(F.col("last") > F.col("first"), F.floor((F.col("last") - F.col("first") - 1) / hop) + 1).otherwise(0).cast("long"))
    ends = F.broadcast(ends) if not keys else ends  # one row without keys
    rows = us.join(ends, list(keys)) if keys else us.crossJoin(ends)
    since = F.col("us") - F.col("first")
    low = F.greatest(F.lit(0), F.floor((since - width_us) / hop) + 1).cast("long")
    high = F.least(F.floor(since / hop), F.col("n") - 1).cast("long")
    hit = rows.where((since >= 0) & (low <= high)).select(*keys, F.explode(F.sequence(low, high)).alias("k"), "value")
    means = hit.groupBy(*keys, "k").agg(op("value").alias("value"))
    grid = ends.where("n > 0").select(*keys, "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    label = from_utc_us(F.col("first") + F.col("k") * hop + width_us // 2).alias("label")
    return grid.join(means, [*keys, "k"], "left").select(*keys, label, "value")


def gap_fill(df: DataFrame, ts: str, value: str, keys: tuple[str, ...] = (), factor: float = 1.5, absolute_us: int | None = None, bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """The rows of ``df`` and, amid each gap longer than ``factor`` times the median step (or than ``absolute``), a null row.

    Steps are taken to the row before, in buckets of time, and the median step is found by counting, so one long series is
    many tasks' work.
    """
    rows = df.select(*keys, ts, value, utc_us(F.col(ts)).alias("_us"))
    steps = previous(rows, "_us", ["_us"], keys, F.floor(F.col("_us") / bucket_us), "_before").withColumn("step", F.col("_us") - F.col("_before"))
    if absolute_us is None:
        from tideframe.operators.statistics import quantiles

        middle = quantiles(steps, "step", {"_middle": 0.5}, keys).select(*keys, (F.col("_middle") * factor).alias("most"))
        steps = steps.join(middle, list(keys), "left") if keys else steps.crossJoin(F.broadcast(middle))
    else:
        steps = steps.withColumn("most", F.lit(absolute_us))
    mid = from_utc_us(F.col("_before") + F.floor(F.col("step") / 2).cast("long")).cast(df.schema[ts].dataType)
    own = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    rows = F.when(F.col("step") > F.col("most"), F.array(own, F.struct(mid.alias("t"), F.lit(None).cast(df.schema[value].dataType).alias("v")))).otherwise(F.array(own))
    return steps.select(*keys, F.explode(rows).alias("r")).select(*keys, F.col("r.t").alias(ts), F.col("r.v").alias(value))


def carried(df: DataFrame, keys: tuple[str, ...], order: str, what: dict[str, Column], bucket: Column | None = None, ahead: bool = False) -> DataFrame:
    """``df`` with, for each name in ``what``, the last non-null value at or before each row (``ahead``: the first from it on).

    With ``bucket`` (monotone in ``order``) a key's series is cut into buckets that are windowed apart; what enters a bucket
    comes from one summary row for each bucket, so a single hot key is spread over many tasks.
    """
    names = list(what)
    df = df.withColumns({f"_{n}": c for n, c in what.items()})
    # looking ahead is looking back in falling order: frames that grow cost one step a row, frames that shrink are made anew
    turned = lambda c: F.col(c).desc() if ahead else F.col(c)
    back = (Window.unboundedPreceding, Window.currentRow)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(turned(order)).rangeBetween(*back)
        return df.withColumns({n: F.last(f"_{n}", True).over(w) for n in names}).drop(*(f"_{n}" for n in names))
    df = df.withColumn("_bucket", bucket)
    edge = F.min_by if ahead else F.max_by
    inner = Window.partitionBy(*keys, "_bucket").orderBy(turned(order)).rangeBetween(*back)
    sums = df.groupBy(*keys, "_bucket").agg(*(edge(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_edge_{n}") for n in names))
    outer = Window.partitionBy(*keys).orderBy(turned("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    entry = sums.select(*keys, "_bucket", *(F.last(f"_edge_{n}", True).over(outer).alias(f"_in_{n}") for n in names))
    df = df.withColumns({n: F.last(f"_{n}", True).over(inner) for n in names}).join(entry, [*keys, "_bucket"])
    df = df.withColumns({n: F.coalesce(n, f"_in_{n}") for n in names})
    return df.drop("_bucket", *(f"_{n}" for n in names), *(f"_in_{n}" for n in names))


def derivative(df: DataFrame, ts: str, value: str, keys: tuple[str, ...] = (), out: str = "rate") -> DataFrame:
    """Second-order time derivative per second: central inside, three-point at the ends of a series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k else F.col(value)
    t = lambda k: (F.lead(ts, k).over(w) if k > 0 else F.lag(ts, -k).over(w) if k else F.col(ts))
    span = lambda a, b: (utc_us(t(b)) - utc_us(t(a))) / 1e6
    central = F.try_divide(x(1) - x(-1), span(-1, 1))
    first = F.try_divide(-x(2) + 4 * x(1) - 3 * x(0), span(0, 2))
    last = F.try_divide(3 * x(0) - 4 * x(-1) + x(-2), span(-2, 0))
    rate = F.when(F.lag(ts).over(w).isNull(), first).when(F.lead(ts).over(w).isNull(), last).otherwise(central)
    return df.withColumn(out, rate)


def gradient(df: DataFrame, along: str, value: str, keys: tuple[str, ...] = (), out: str = "slope") -> DataFrame:
    """Derivative along a coordinate: central inside, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(along)
    up, down = F.lead(value).over(w), F.lag(value).over(w)
    far, near = F.lead(along).over(w), F.lag(along).over(w)
    v, a = F.col(value), F.col(along)
    slope = F.when(near.isNull(), F.try_divide(up - v, far - a)).when(far.isNull(), F.try_divide(v - down, a - near)).otherwise(F.try_divide(up - down, far - near))
    return df.withColumn(out, slope)


def values_to_steps(df: DataFrame, value: str, keys: tuple[str, ...] = (), out: str = "step") -> DataFrame:
    """Index of each value among the sorted distinct values of its key; only distinct values are ranked."""
    distinct = df.select(*keys, value).distinct()
    ranks = distinct.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1)
    return df.join(ranks, [*keys, value])


def previous(df: DataFrame, value: str, order: list[str], keys: tuple[str, ...], bucket: Column, out: str = "previous") -> DataFrame:
    """``df`` with ``value`` of the row before in its key; ``bucket`` (monotone in ``order``) cuts a key's rows over many tasks."""
    df = df.withColumn("_bucket", bucket)
    place = F.struct(*order)
    edges = df.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), place).alias("_edge"))
    entry = edges.select(*keys, "_bucket", F.lag("_edge").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_in"))
    inner = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    rows = df.withColumn("_own", inner).join(entry, [*keys, "_bucket"])
    return rows.withColumn(out, F.coalesce("_own", "_in")["v"]).drop("_bucket", "_own", "_in")


def out_of_order(df: DataFrame, ts: str, record: str, keys: tuple[str, ...] = (), bucket: Column | None = None) -> DataFrame:
    """Records whose time is before that of the record before; with ``bucket`` (monotone in ``record``) over many tasks a key."""
    if bucket is None:
        rows = df.withColumn("_before", F.lag(ts).over(Window.partitionBy(*keys).orderBy(record)))
    else:
        rows = previous(df, ts, [record], keys, bucket, "_before")
    return rows.where(F.col(ts) < F.col("_before")).drop("_before")


def refractory(df: DataFrame, ts: str, period_us: int, keys: tuple[str, ...], bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """Events kept when later than the last kept one by more than ``period``; of events at one time the first by the other columns.

    An event after a gap longer than ``period`` is kept whatever came before. From any event the next kept one is the first
    later by more than the period, which a look ahead in buckets of time finds; from the events after gaps these links are
    followed by doubling their length, so a run of n kept events takes log n joins, each over all tasks.
    """
    us = df.select(*keys, utc_us(F.col(ts)).alias("_us")).where("_us is not null").distinct()
    bucket = F.floor(F.col("_us") / bucket_us)
    rows = previous(us, "_us", ["_us"], keys, bucket, "_before")
    starts = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > period_us)
    times = stored(rows.select(*keys, "_us", starts.alias("_start")), "refractory-times")
    both = times.select(*keys, "_us", "_start", F.col("_us").alias("_knot"), F.lit(None).cast("long").alias("_from"))
    asked = times.select(*keys, (F.col("_us") + period_us + 1).alias("_us"), F.lit(False).alias("_start"), F.lit(None).cast("long").alias("_knot"), F.col("_us").alias("_from"))
    knot = F.when(F.col("_knot").isNotNull(), F.struct(F.col("_knot").alias("us"), F.col("_start").alias("start")))
    links = carried(both.unionByName(asked), keys, "_us", {"_next": knot}, bucket, ahead=True).where("_from is not null and _next is not null and not _next.start")
    links = stored(links.select(*keys, F.col("_from").alias("_us"), F.col("_next.us").alias("_to")), "refractory-links")
    kept = times.where("_start").select(*keys, "_us")
    while not links.isEmpty():
        found = kept.join(links, [*keys, "_us"]).select(*keys, F.col("_to").alias("_us"))
        kept = stored(kept.unionByName(found), "refractory-kept")
        ahead = links.select(*keys, F.col("_us").alias("_to"), F.col("_to").alias("_far"))
        links = stored(links.join(ahead, [*keys, "_to"]).select(*keys, "_us", F.col("_far").alias("_to")), "refractory-links")
    others = [c for c in df.columns if c not in keys]
    one = F.row_number().over(Window.partitionBy(*keys, "_us").orderBy(*others))
    return df.withColumn("_us", utc_us(F.col(ts))).join(kept, [*keys, "_us"], "left_semi").withColumn("_n", one).where("_n = 1").select(*df.columns)


def sessions(df: DataFrame, ts: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    """Start, end and number of events of runs without a longer gap."""
    plain = F.col(ts).cast("timestamp")
    return df.select(*keys, plain.alias("t")).groupBy(*keys, F.session_window("t", gap)).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def row_numbers(df: DataFrame, order: list[str], bucket: Column, out: str = "row", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with 0-based row numbers over the whole input, or over each key, ordered by ``order``.

    ``bucket`` is monotone in ``order``: rows are numbered within their bucket and shifted by the counts of the buckets
    before, so that no task gets more than one bucket of one key.
    """
    rows = df.withColumn("_bucket", bucket)
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*keys, "_bucket").count().select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    same = rows["_bucket"].eqNullSafe(counts["_b"])
    for k in keys:
        same = same & rows[k].eqNullSafe(counts[f"_k_{k}"])
    return rows.join(counts, same).withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_b", "_before", *(f"_k_{k}" for k in keys))
