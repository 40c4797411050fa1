"""Robust statistics, histograms, rebinning and bootstraps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.storage import small, stored


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], keys: tuple[str, ...] = (), buckets: int = 1024, limit: int = 100_000, kept: bool = False) -> DataFrame:
    """(keys, one column for each name in ``wanted``): exact quantiles, interpolated between neighbours; nulls and NaN don't count.

    No task orders more than ``limit`` values. An interval of values with more is cut into buckets of equal width, which are
    counted; those that hold a wanted rank go on as intervals of their own, from their least to their greatest value,
    until they are small or hold one value alone. So neither a hot key nor values bunched beside an outlier meet in one task.
    The values are stored first, since they are read in every pass, unless ``kept`` says that ``df`` is a stored table.
    """
    if not keys:
        return quantiles(df.select(F.lit(0).alias("_all"), value), value, wanted, ("_all",), buckets, limit, kept).drop("_all")
    number = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_v"))
    rows = rows if kept else stored(rows, "quantile-values")
    place = {n: F.lit(float(q)) * (F.col("_total") - 1) for n, q in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at), F.ceil(at)) for at in place.values()))))
    open_ = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    open_ = open_.select(*keys, "_low", "_high", "_n", F.lit(0).cast("long").alias("_from"), F.col("_n").alias("_total")).withColumn("_ranks", ranks)
    found = None
    while True:
        open_ = stored(open_, "quantile-intervals")
        flat = open_.where("_low = _high").select(*keys, "_total", F.explode("_ranks").alias("_rank"), F.col("_low").alias("_value"))
        within = lambda some: rows.join(small(some, 128), list(keys)).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        few = within(open_.where((F.col("_low") < F.col("_high")) & (F.col("_n") <= limit)))
        few = few.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_low").orderBy("_v")) - 1 + F.col("_from"))
        few = few.where(F.array_contains("_ranks", F.col("_rank"))).select(*keys, "_total", "_rank", F.col("_v").alias("_value"))
        found = flat.unionByName(few) if found is None else found.unionByName(flat).unionByName(few)
        many = open_.where((F.col("_low") < F.col("_high")) & (F.col("_n") > limit))
        if many.isEmpty():
            break
        share = F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * buckets)
        cut = within(many).withColumn("_b", F.least(share, F.lit(buckets - 1)))
        counts = cut.groupBy(*keys, "_total", "_from", "_ranks", "_b").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*keys, "_from").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_first", F.col("_from") + F.coalesce(before, F.lit(0)))
        held = F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_n")))
        open_ = counts.withColumn("_ranks", held).where(F.size("_ranks") > 0).select(*keys, "_low", "_high", "_n", F.col("_first").alias("_from"), "_total", "_ranks")
    known = found.groupBy(*keys, "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_m"))  # two ranks for each name
    at = lambda x, f: F.element_at("_m", f(x).cast("long"))
    return known.select(*keys, *((at(x, F.floor) + (at(x, F.ceil) - at(x, F.floor)) * (x - F.floor(x))).alias(n) for n, x in place.items()))


def median_absolute_deviation(df: DataFrame, value: str, keys: tuple[str, ...] = (), scale: bool = False) -> DataFrame:
    """(keys, median, mad): the median and the median distance from it."""
    df = stored(df.select(*keys, value), "deviations")
    mid = quantiles(df, value, {"median": 0.5}, keys, kept=True)
    mid = stored(mid, "medians")
    rows = df.join(mid, list(keys)) if keys else df.crossJoin(F.broadcast(mid))
    far = quantiles(rows.select(*keys, F.abs(F.col(value) - F.col("median")).alias("far")), "far", {"mad": 0.5}, keys)
    out = mid.join(far, list(keys)) if keys else mid.crossJoin(F.broadcast(far))
    return out.select(*keys, "median", (F.col("mad") * 1.4826 if scale else F.col("mad")).alias("mad"))


def histogram_rule(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, width, bins) by the quartile rule; by the root of the count where that rule gives no or too many bins."""
    q = quantiles(df, value, {"a": 0.25, "b": 0.75}, keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    q = q.join(ends, list(keys)) if keys else q.crossJoin(F.broadcast(ends))
    width = 2 * (F.col("b") - F.col("a")) / F.cbrt(F.col("n").cast("double"))
    q = q.withColumn("width", width).withColumn("bins", F.when(width != 0, F.bround(F.try_divide(F.col("high") - F.col("low"), width))))
    poor = F.col("bins").isNull() | (F.col("bins") == 0) | (F.col("bins") >= F.col("n") / 2)
    root = F.bround(F.sqrt(F.col("n").cast("double")))
    return q.select(*keys, F.when(poor, F.col("n") / root).otherwise(F.col("width")).alias("width"), F.when(poor, root).otherwise(F.col("bins")).cast("long").alias("bins"))


def bin_of(x: Column, low: Column | float, width: Column | float, bins: Column | int) -> Column:
    """0-based bin of equal widths; the top edge is in the last bin; null outside."""
    low, width, bins = (v if isinstance(v, Column) else F.lit(v) for v in (low, width, bins))
    k = F.floor((x - low) / width)
    return F.when((x >= low) & (x <= low + width * bins), F.least(k, bins - 1)).cast("long")


def spectrogram(df: DataFrame, x: Column, y: Column, z: Column, x_edges: tuple[float, float, int], y_edges: tuple[float, float, int], z_limits: tuple[float, float] | None = None) -> DataFrame:
    """(x_bin, y_bin, n, total, mean) of z over a grid of (low, width, bins)."""
    rows = df.select(bin_of(x, *x_edges).alias("x_bin"), bin_of(y, *y_edges).alias("y_bin"), z.alias("z"))
    if z_limits:
        rows = rows.where(F.col("z").between(*z_limits))
    rows = rows.where("x_bin is not null and y_bin is not null and z is not null")
    return rows.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"), F.sum("z").alias("total"), F.avg("z").alias("mean"))


def merge_spectrograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """The spectrogram of both inputs together, from their counts and sums."""
    both = a.select("x_bin", "y_bin", "n", "total").union(b.select("x_bin", "y_bin", "n", "total"))
    out = both.groupBy("x_bin", "y_bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def rebin(df: DataFrame, at: Column, value: Column, edges: list[float], keys: tuple[str, ...] = (), weight: Column | None = None, delta: Column | None = None, clip: bool = False) -> DataFrame:
    """(keys, bin, count, mean, unc) of ``value`` over bins of ``at``.

    Without ``delta`` a value is in the bin from its edge to before the next (with ``clip`` values beyond the ends count in
    the end bins); with it in each bin by the share of [at - delta, at + delta] there. Nulls don't count; empty bins have
    no row.
    """
    n = len(edges) - 1
    low, high = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    rows = df.select(*keys, at.alias("_x"), value.alias("_v"), (F.lit(1.0) if weight is None else weight).alias("_w"), (F.lit(0.0) if delta is None else delta).alias("_d"))
    if clip:
        rows = rows.withColumn("_x", F.greatest(F.least("_x", F.lit(math.nextafter(edges[-1], -math.inf))), F.lit(edges[0])))
    rows = rows.where(F.col("_v").isNotNull() & F.col("_x").isNotNull())
    rows = rows.select(*keys, "_x", "_v", "_w", "_d", F.posexplode(F.arrays_zip(low.alias("lo"), high.alias("hi"))).alias("bin", "e")) if delta is not None else rows.withColumn(
        "bin", F.size(F.filter(low, lambda e: e <= F.col("_x"))) - 1
    ).where((F.col("bin") >= 0) & (F.col("_x") < edges[n]))
    if delta is not None:
        share = (F.least(F.col("_x") + F.col("_d"), F.col("e.hi")) - F.greatest(F.col("_x") - F.col("_d"), F.col("e.lo"))) / (2 * F.col("_d"))
        rows = rows.withColumn("_w", F.col("_w") * F.greatest(share, F.lit(0.0))).where("_w > 0")
    total, sum_ = F.sum("_w"), F.sum(F.col("_w") * F.col("_v"))
    unc = F.sqrt(F.sum(F.col("_w") * F.col("_w") * F.col("_v") * F.col("_v")))
    return rows.groupBy(*keys, "bin").agg(total.alias("count"), F.try_divide(sum_, total).alias("mean"), F.try_divide(unc, total).alias("unc"))


def percentile_of(df: DataFrame, value: str, target: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, percentile) of ``target`` among the values: interpolated between them, the middle of equal ones, 0 and 100 outside."""
    v = F.col(value)
    s = df.groupBy(*keys).agg(
        F.count_if(v < target).alias("lt"), F.count_if(v <= target).alias("le"), F.count(v).alias("n"), F.max(F.when(v < target, v)).alias("below"), F.min(F.when(v > target, v)).alias("above")
    )
    between = (F.col("lt") - 1 + F.try_divide(target - F.col("below"), F.col("above") - F.col("below"))) * 100.0 / (F.col("n") - 1)
    ties = (F.col("lt") + F.col("le") - 1) / 2 * 100.0 / (F.col("n") - 1)
    return s.select(*keys, F.when(F.col("le") == 0, 0.0).when(F.col("lt") == F.col("n"), 100.0).when(F.col("lt") == F.col("le"), between).otherwise(ties).alias("percentile"))


def poisson_steps(mean: float) -> list[float]:
    """The cumulative probabilities of a Poisson distribution, until nothing of note is left."""
    term = total = math.exp(-mean)
    out = [total]
    while total < 1 - 1e-12 and len(out) < 200:
        term *= mean / len(out)
        total += term
        out.append(total)
    return out


#: A prime of 31 bits; squares of what is below it fit a long.
PRIME = 2147483647


def uniform(key: Column, rep: Column) -> Column:
    """A reproducible number in [0, 1) for a row's long ``key`` and a replicate: quadratic maps modulo a prime."""
    prime = F.lit(PRIME).cast("long")
    a, rep = F.pmod(key.cast("long"), prime), rep.cast("long")
    x = F.pmod(a * 48271 + rep * 69621 + 1, prime)
    for factor, plus in ((7, rep + 3), (11, a), (13, F.lit(5))):
        x = F.pmod(x * x + x * factor + plus, prime)
    return x / float(PRIME)


def resampled(df: DataFrame, key: Column, reps: int, mean: float = 1.0) -> DataFrame:
    """``df`` with (rep, weight): how often each of ``reps`` resamplings draws each row, as Poisson numbers; rows drawn alone.

    Each row draws for itself where it is read, so resampling needs no numbering and no join, and what follows aggregates
    before its shuffle. The sizes of the samples vary as the square root of their mean; totals are scaled by them.
    """
    rows = df.withColumn("_key", key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_u", uniform(F.col("_key"), F.col("rep")))
    times = F.lit(0)
    for k, c in enumerate(poisson_steps(mean)):
        times = F.when(F.col("_u") < c, k) if k == 0 else times.when(F.col("_u") < c, k)
    weight = times.otherwise(len(poisson_steps(mean)))
    return rows.withColumn("weight", weight).drop("_key", "_u").where("weight > 0")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def bootstrap(df: DataFrame, value: str, key: Column, reps: int, agg: Callable[[Column, Column], Column] = weighted_mean, mean: float = 1.0) -> DataFrame:
    """(rep, stat) of ``agg`` of value and weight over resampled rows; ``key`` tells rows apart, ``mean`` scales the samples."""
    rows = resampled(df.select(F.col(value).alias("value"), key.alias("key")), F.col("key"), reps, mean)
    return rows.groupBy("rep").agg(agg(F.col("value"), F.col("weight")).alias("stat"))


def interval(stats: DataFrame, percent: float = 90.0) -> DataFrame:
    """(low, high) that hold the middle ``percent`` of the replicates."""
    tail = (1 - percent / 100) / 2
    return stats.agg(F.percentile("stat", F.lit(tail)).alias("low"), F.percentile("stat", F.lit(1 - tail)).alias("high"))


def normalized(df: DataFrame, value: str, keys: tuple[str, ...] = (), low: float = 0.0, high: float = 1.0, out: str = "normalized") -> DataFrame:
    """``value`` mapped linearly so that its range becomes [low, high]."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    rows = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))
    return rows.withColumn(out, low + (high - low) * F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def poisson_rate(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rate): the most likely rate of Poisson counts, which is their mean."""
    return df.groupBy(*keys).agg(F.avg(value).alias("rate"))


def spectrogram_slice(cells: DataFrame, at: float, axis: str, edges: tuple[float, float, int]) -> DataFrame:
    """The cells of a spectrogram in the bin of ``axis`` (x_bin or y_bin) that holds ``at``."""
    return cells.where(F.col(axis) == bin_of(F.lit(at), *edges))


def histogram_interval(df: DataFrame, value: str, key: Column, low: float, width: float, bins: int, reps: int, percent: float = 90.0) -> DataFrame:
    """(bin, n, low, high): the counts of all bins and the middle ``percent`` of their counts over resampled data.

    Rows are weighted where they are read; ``reps`` times ``bins`` rows of each task are shuffled.
    """
    rows = df.select(bin_of(F.col(value), low, width, bins).alias("bin"), key.alias("key"))
    spark, n = df.sparkSession, df.count()
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    drawn = resampled(rows, F.col("key"), reps).groupBy("rep", "bin").agg(F.sum("weight").alias("c"))
    sizes = drawn.groupBy("rep").agg(F.sum("c").alias("size"))
    hits = drawn.where("bin is not null").join(sizes, "rep").select("rep", "bin", (F.col("c") * n / F.col("size")).alias("c"))
    every = spark.range(reps * bins).select(F.floor(F.col("id") / bins).alias("rep"), (F.col("id") % bins).alias("bin"))
    tail = (1 - percent / 100) / 2
    counts = every.join(hits, ["rep", "bin"], "left").groupBy("bin").agg(*(F.percentile(F.coalesce("c", F.lit(0.0)), F.lit(q)).alias(n) for q, n in ((tail, "low"), (1 - tail, "high"))))
    sample = rows.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return grid.join(sample, "bin", "left").join(counts, "bin").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "low", "high")


def on_grid(x: Column, low: float, step: float, count: int) -> Column:
    """Nearest of ``count`` grid points from ``low`` by ``step``, the lower one at a tie."""
    return low + step * F.least(F.greatest(F.ceil((x - low) / step - 0.5), F.lit(0)), F.lit(count - 1))


def grid_means(df: DataFrame, at: str, value: str, low: float, step: float, count: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, at, value, n): observations moved to the nearest grid point and averaged there."""
    rows = df.select(*keys, on_grid(F.col(at), low, step, count).alias(at), F.col(value).alias("_v"))
    return rows.groupBy(*keys, at).agg(F.avg("_v").alias(value), F.count("_v").alias("n"))
