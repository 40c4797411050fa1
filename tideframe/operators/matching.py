"""Matching in time: overlap, common times, as-of, nearest, interpolation, interval maxima, associations, epochs.

Range predicates without an equality are given one: times are cut into buckets as wide as the window, the small side is
sent to its own and the neighbouring buckets, and the exact predicate follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.timescales import DAY_US, utc_us
from tideframe.operators.series import carried, row_numbers
from tideframe.operators.statistics import resampled


def overlap(df: DataFrame, other: DataFrame, ts: str) -> DataFrame:
    """Rows of ``df`` within the first and last time of ``other``, both ends included."""
    bounds = other.agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))
    return df.join(F.broadcast(bounds), F.col(ts).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def common(df: DataFrame, other: DataFrame, ts: str, mark: str | None = None) -> DataFrame:
    """Rows of ``df`` whose time is in ``other``; with ``mark`` all rows and a boolean column."""
    if mark is None:
        return df.join(other.select(ts), ts, "left_semi")
    return df.join(other.select(ts).distinct().withColumn("_in", F.lit(True)), ts, "left").withColumn(mark, F.coalesce("_in", F.lit(False))).drop("_in")


def _stacked(queries: DataFrame, knots: DataFrame, ts: str, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    queries = queries.withColumn("_us", utc_us(F.col(ts))).withColumn("_query", F.lit(True))
    knots = knots.select(*keys, utc_us(F.col(ts)).alias("_us"), F.struct(utc_us(F.col(ts)).alias("us"), *values).alias("_knot")).withColumn("_query", F.lit(False))
    return queries.unionByName(knots, allowMissingColumns=True)


def as_of(queries: DataFrame, knots: DataFrame, ts: str, keys: tuple[str, ...], values: tuple[str, ...], bucket_us: int | None = None) -> DataFrame:
    """``queries`` with the ``values`` of the last knot at or before each; null where there is none."""
    bucket = None if bucket_us is None else F.floor(F.col("_us") / bucket_us)
    out = carried(_stacked(queries, knots, ts, keys, values), keys, "_us", {"_last": F.col("_knot")}, bucket).where("_query")
    return out.select(*queries.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def _around(queries, knots, ts, keys, values, bucket_us) -> DataFrame:
    bucket = None if bucket_us is None else F.floor(F.col("_us") / bucket_us)
    rows = carried(_stacked(queries, knots, ts, keys, values), keys, "_us", {"_last": F.col("_knot")}, bucket)
    return carried(rows, keys, "_us", {"_next": F.col("_knot")}, bucket, ahead=True).where("_query")


def nearest(queries: DataFrame, knots: DataFrame, ts: str, keys: tuple[str, ...], values: tuple[str, ...], bucket_us: int | None = None) -> DataFrame:
    """``queries`` with the ``values`` of the nearest knot, the earlier one on a tie, and its distance in microseconds."""
    rows = _around(queries, knots, ts, keys, values, bucket_us)
    before, after = F.col("_us") - F.col("_last.us"), F.col("_next.us") - F.col("_us")
    early = F.coalesce(before <= after, before.isNotNull())
    best = F.when(early, F.col("_last")).otherwise(F.col("_next"))
    return rows.withColumn("_best", best).select(*queries.columns, F.abs(F.col("_best.us") - F.col("_us")).alias("distance_us"), *(F.col(f"_best.{v}").alias(v) for v in values))


def interpolate(queries: DataFrame, knots: DataFrame, ts: str, keys: tuple[str, ...], value: str, period: float | None = None, bucket_us: int | None = None) -> DataFrame:
    """``queries`` with ``value`` interpolated linearly between the knots around each; null outside.

    With ``period`` the value is an angle of that period, interpolated by its sine and cosine.
    """
    rows = _around(queries, knots, ts, keys, (value,), bucket_us)
    a, b = F.col(f"_last.{value}"), F.col(f"_next.{value}")
    share = F.try_divide(F.col("_us") - F.col("_last.us"), F.col("_next.us") - F.col("_last.us"))
    blend = lambda x, y: F.when(F.col("_last.us") == F.col("_next.us"), x).otherwise(x + (y - x) * share)
    if period is None:
        out = blend(a, b)
    else:
        turn = 2 * 3.141592653589793 / period
        out = F.pmod(F.atan2(blend(F.sin(a * turn), F.sin(b * turn)), blend(F.cos(a * turn), F.cos(b * turn))) / turn, F.lit(float(period)))
    return rows.select(*queries.columns, out.alias(value))


def interval_max(queries: DataFrame, series: DataFrame, ts: str, value: str, prior_us: int, key: str) -> DataFrame:
    """(key, maximum) of ``value`` from ``prior`` before each query to the query, both ends included; null if nothing is there."""
    # times are cut at multiples of the width: the interval is the end of one piece and the beginning of the next, and in each
    # the largest value so far, from the piece's end back or from its beginning on, is one running maximum; no pair is made
    width = max(prior_us, 1)
    q = queries.select(key, utc_us(F.col(ts)).alias("_at"))
    s = series.select(utc_us(F.col(ts)).alias("_us"), F.col(value).alias("_v")).where("_us is not null")
    on = lambda rows, us, back: rows.withColumns({"_back": F.lit(back), "_b": F.floor(us / width), "_order": -us if back else us})
    asked = q.where("_at is not null").select(key, "_at")
    sides = []
    for back in (False, True) if prior_us else (False,):
        ends = on(asked, F.col("_at") - prior_us if back else F.col("_at"), back).select(key, F.lit(None).cast(s.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_asked"), "_back", "_b", "_order")
        known = on(s, F.col("_us"), back).select(F.lit(None).cast(asked.schema[key].dataType).alias(key), "_v", F.lit(False).alias("_asked"), "_back", "_b", "_order")
        sides.append(ends.union(known))
    rows = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    so_far = Window.partitionBy("_back", "_b").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hit = rows.withColumn("_most", F.max("_v").over(so_far)).where("_asked")
    return q.select(key).join(hit.groupBy(key).agg(F.max("_most").alias(value)), key, "left")


def _counts(a: DataFrame, b: DataFrame, lags: DataFrame, half_us: int, bucket_us: int = DAY_US) -> DataFrame:
    """``a`` (time ``a``, ...) with each lag and ``c``, how many of ``b`` (time ``b``) are within ``half`` of time plus lag.

    The times of ``b`` are numbered in order; the events up to the window's end less those up to its beginning are those in
    it. So no pair is made, whatever falls into one window; both ends look their number up in buckets of time.
    """
    names = a.columns
    times = b.groupBy(F.col("b").alias("_us")).agg(F.count("*").alias("_many"))
    bucket = F.floor(F.col("_us") / bucket_us)
    sums = times.groupBy(bucket.alias("_k")).agg(F.sum("_many").alias("_sum"))
    back = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums = sums.select("_k", F.coalesce(F.sum("_sum").over(back), F.lit(0)).alias("_back"))
    inner = F.sum("_many").over(Window.partitionBy("_k").orderBy("_us").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    knots = times.withColumn("_k", bucket).withColumn("_inner", inner).join(sums, "_k").select("_us", (F.col("_inner") + F.col("_back")).alias("_upto"))
    ends = F.explode(F.array(F.struct((F.col("_at") - half_us - 1).alias("us"), F.lit(-1).alias("sign")), F.struct((F.col("_at") + half_us).alias("us"), F.lit(1).alias("sign"))))
    asked = a.crossJoin(F.broadcast(lags)).withColumn("_at", F.col("a") + F.col("lag_us")).withColumn("_e", ends)
    asked = asked.select(*names, "lag_us", F.col("_e.us").alias("_us"), F.col("_e.sign").alias("_sign"), F.lit(None).cast("long").alias("_upto"))
    rows = asked.unionByName(knots, allowMissingColumns=True).withColumn("_g", F.lit(0))
    rows = carried(rows, ("_g",), "_us", {"_number": F.col("_upto")}, bucket).where("lag_us is not null")
    return rows.groupBy(*names, "lag_us").agg(F.sum(F.col("_sign") * F.coalesce("_number", F.lit(0))).alias("c"))


def association(first: DataFrame, second: DataFrame, ts: str, lags_us: list[int], half_us: int) -> DataFrame:
    """(lag_us, total, expected): pairs of events of two processes, the second within ``half`` of the first plus a lag.

    Counts come from the differences of two numbers in the order of the second process, so pairs are never made.
    """
    spark = first.sparkSession
    lags = spark.createDataFrame([(x,) for x in lags_us], "lag_us long")
    a = first.select(utc_us(F.col(ts)).alias("a"))
    b = second.select(utc_us(F.col(ts)).alias("b"))
    each = a.groupBy("a").agg(F.count("*").alias("_n"))  # events at one time have one count
    hits = _counts(each, b, lags, half_us).groupBy("lag_us").agg(F.sum(F.col("c") * F.col("_n")).alias("count"))
    totals = lags.join(hits, "lag_us", "left").select("lag_us", F.coalesce("count", F.lit(0)).alias("total"))
    a0, a1 = a.agg(F.min("a"), F.max("a")).first()
    b0, b1 = b.agg(F.min("b"), F.max("b")).first()
    if a0 is None or b0 is None:
        return totals.select("lag_us", "total", F.lit(0.0).alias("expected"))
    spans = [(lag, max(a0 + lag, b0) - half_us, min(a1 + lag, b1) + half_us) for lag in lags_us]
    ends = spark.createDataFrame(spans, "lag_us long, start long, stop long")
    # the events that could take part at each lag are counted in one pass over each process
    within = lambda df, c, shift: df.agg(*(F.count_if(F.col(c).between(lo - lag * shift, hi - lag * shift)).alias(f"n{k}") for k, (lag, lo, hi) in enumerate(spans))).first()
    one, two = within(a, "a", 1), within(b, "b", 0)
    n1 = spark.createDataFrame([(lag, one[k]) for k, lag in enumerate(lags_us)], "lag_us long, n1 long")
    n2 = spark.createDataFrame([(lag, two[k]) for k, lag in enumerate(lags_us)], "lag_us long, n2 long")
    out = totals.join(ends, "lag_us").join(n1, "lag_us", "left").join(n2, "lag_us", "left")
    n = F.coalesce("n1", F.lit(0)).cast("double") * F.coalesce("n2", F.lit(0))
    return out.select("lag_us", "total", F.coalesce(F.try_divide(2.0 * n * half_us, F.col("stop") - F.col("start")), F.lit(0.0)).alias("expected"))


def superposed_epochs(series: DataFrame, epochs: DataFrame, ts: str, value: str, keys: tuple[str, ...], half: int, aggregates: dict[str, Column] | None, bucket_us: int = DAY_US) -> DataFrame:
    """(lag, aggregates), or (lag, value) rows without aggregates, over the rows from ``half`` before to ``half`` after the sample nearest to each epoch.

    ``aggregates`` are over the column ``value``. Epochs whose rows would leave the series are dropped. Samples are numbered
    and epochs matched in buckets of time, so that no task gets a whole series.
    """
    rows = series.select(*keys, ts, F.col(value).alias("value"))
    numbered = row_numbers(rows, [ts], F.floor(utc_us(F.col(ts)) / bucket_us), "row", keys)
    ends = numbered.groupBy(*keys).agg(F.max("row").alias("last"))
    anchors = nearest(epochs.select(*keys, ts), numbered, ts, keys, ("row",), bucket_us).join(ends, list(keys))
    anchors = anchors.where((F.col("row") >= half) & (F.col("row") + half <= F.col("last")))
    wanted = anchors.select(*keys, "row", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("lag")).select(*keys, (F.col("row") + F.col("lag")).alias("row"), "lag")
    hit = wanted.join(numbered.select(*keys, "row", "value"), [*keys, "row"])
    return hit.select("lag", "value") if aggregates is None else hit.groupBy("lag").agg(*(c.alias(n) for n, c in aggregates.items()))


def association_interval(first: DataFrame, second: DataFrame, ts: str, key: list[str], lags_us: list[int], half_us: int, reps: int, percent: float = 95.0) -> DataFrame:
    """(lag_us, total, low, high): associations at each lag and the middle ``percent`` of them when the first process is resampled.

    An event's count at a lag is computed once; a replicate's total is the sum of counts times how often it drew the event,
    which each event, told apart by its ``key`` columns, draws for itself, scaled to the events there are.
    """
    spark = first.sparkSession
    lags = spark.createDataFrame([(x,) for x in lags_us], "lag_us long")
    number = F.col(key[0]).cast("long") if len(key) == 1 and first.schema[key[0]].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(*key)
    a = first.select(number.alias("i"), utc_us(F.col(ts)).alias("a"))
    hits = _counts(a, second.select(utc_us(F.col(ts)).alias("b")), lags, half_us).where("c > 0").select("lag_us", "i", "c")
    n = first.count()
    sizes = resampled(a.select("i"), F.col("i"), reps).groupBy("rep").agg(F.sum("weight").alias("size"))
    sums = resampled(hits, F.col("i"), reps).groupBy("lag_us", "rep").agg(F.sum(F.col("weight") * F.col("c")).alias("s")).join(sizes, "rep")
    sums = sums.select("lag_us", "rep", (F.col("s") * n / F.col("size")).alias("stat"))
    every = lags.crossJoin(spark.range(reps).withColumnRenamed("id", "rep")).join(sums, ["lag_us", "rep"], "left")
    tail = (1 - percent / 100) / 2
    spread = every.groupBy("lag_us").agg(*(F.percentile(F.coalesce("stat", F.lit(0.0)), F.lit(q)).alias(n) for q, n in ((tail, "low"), (1 - tail, "high"))))
    totals = hits.groupBy("lag_us").agg(F.sum("c").alias("total"))
    return spread.join(totals, "lag_us", "left").select("lag_us", F.coalesce("total", F.lit(0)).alias("total"), "low", "high")


def epochs_within(epochs: DataFrame, series: DataFrame, ts: str, margin_us: int) -> DataFrame:
    """Epochs whose window of ``margin`` on both sides lies within the series."""
    ends = series.agg(F.min(utc_us(F.col(ts))).alias("_low"), F.max(utc_us(F.col(ts))).alias("_high"))
    us = utc_us(F.col(ts))
    return epochs.join(F.broadcast(ends), (us >= F.col("_low") + margin_us) & (us <= F.col("_high") - margin_us)).drop("_low", "_high")


def superposed_cells(series: DataFrame, epochs: DataFrame, ts: str, values: str, keys: tuple[str, ...], half: int) -> DataFrame:
    """(lag, channel, value) rows of an array column around the epochs; null channels have none."""
    rows = superposed_epochs(series, epochs, ts, values, keys, half, None)
    return rows.select("lag", F.posexplode("value").alias("channel", "value")).where("value is not null")


def superposed_spectra(series: DataFrame, epochs: DataFrame, ts: str, values: str, keys: tuple[str, ...], half: int, aggregates: dict[str, Column], least: int = 1) -> DataFrame:
    """(lag, channel, n, aggregates) as ``superposed_epochs`` does, for an array column; only cells of ``least`` values or more."""
    cells = superposed_cells(series, epochs, ts, values, keys, half)
    return cells.groupBy("lag", "channel").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in aggregates.items())).where(F.col("n") >= least)


def events_between(df: DataFrame, ts: str, start: str, stop: str, equal: dict[str, object] | None = None) -> DataFrame:
    """Rows strictly between two times with the given values of some columns; all conditions reach the scan."""
    out = df.where((F.col(ts) > F.lit(start).cast(df.schema[ts].dataType)) & (F.col(ts) < F.lit(stop).cast(df.schema[ts].dataType)))
    for name, value in (equal or {}).items():
        out = out.where(F.col(name) == value)
    return out


def all_epochs(epochs: DataFrame, dropped: DataFrame, ts: str) -> DataFrame:
    """The epochs with those that were dropped, each once."""
    return epochs.select(ts).union(dropped.select(ts)).distinct()


def span_of(df: DataFrame, ts: str) -> DataFrame:
    """(first, last): the times at which a table begins and ends; read from the files' statistics where these have them."""
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def side_by_side(analyses: dict[str, DataFrame]) -> DataFrame:
    """Superposed epoch results of several variables as one table, told apart by the column ``variable``."""
    out = None
    for name, df in analyses.items():
        named = df.select(F.lit(name).alias("variable"), "*")
        out = named if out is None else out.unionByName(named)
    return out
