"""Statistics, histograms, rebinning and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import integrals as N
from tideframe.operators import statistics as S
from tideframe.plans.registry import Registry, r6, table

query = Registry()


def weighted_sql(rows: str, reps: int) -> str:
    """SQL of r (k and other columns), d (k, rep, w), how often each replicate draws each row, and z (rep, size)."""
    cuts = " ".join(f"when u < {c!r} then {k}" for k, c in enumerate(S.poisson_steps(1.0)))
    p = S.PRIME
    return f"""
with r as ({rows}), x0 as (select k, rep, k % {p} a, (k % {p} * 48271 + rep * 69621 + 1) % {p} x from r, (select unnest(range({reps})) rep)),
x1 as (select *, (x * x + x * 7 + rep + 3) % {p} x1 from x0), x2 as (select *, (x1 * x1 + x1 * 11 + a) % {p} x2 from x1), x3 as (select k, rep, ((x2 * x2 + x2 * 13 + 5) % {p}) / {p}.0::double u from x2),
d as (select k, rep, case {cuts} else {len(S.poisson_steps(1.0))} end w from x3), z as (select rep, sum(w)::double size, (select count(*) from r) n from d group by rep)"""


@query("""
with m as (select event_type, quantile_cont(value, 0.5) m from events group by event_type)
select event_type, round(any_value(m), 6) median, round(quantile_cont(abs(value - m), 0.5) * 1.4826, 6) mad from events join m using (event_type) group by event_type""")
def mad_by_type(spark, sf_dir):
    out = S.median_absolute_deviation(table(spark, sf_dir, "events"), "value", ("event_type",), scale=True)
    return out.select("event_type", r6("median").alias("median"), r6("mad").alias("mad"))


@query("""
with q as (select event_type, 2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / cbrt(count(*)::double) w, max(value) - min(value) r, count(*) n from events group by event_type),
b as (select *, case when w <> 0 then round_even(r / w, 0) end bins from q)
select event_type, round(case when bins is null or bins = 0 or bins >= n / 2 then n / round_even(sqrt(n), 0) else w end, 6) width,
 (case when bins is null or bins = 0 or bins >= n / 2 then round_even(sqrt(n), 0) else bins end)::bigint bins from b""")
def fd_bins(spark, sf_dir):
    return S.histogram_rule(table(spark, sf_dir, "events"), "value", ("event_type",)).withColumn("width", r6("width"))


@query("""
with b as (select least(floor((value - 0) / 25.0), 19)::bigint x, least(floor(hour(ts) / 2.0), 11)::bigint y, user_id::double z from events where value >= 0 and value <= 500)
select x x_bin, y y_bin, count(*)::bigint n, round(sum(z), 6) total, round(avg(z), 6) mean from b where z between 10 and 140 group by x, y""")
def spectrogram(spark, sf_dir):
    out = S.spectrogram(table(spark, sf_dir, "events"), F.col("value"), F.hour("ts").cast("double"), F.col("user_id").cast("double"), (0.0, 25.0, 20), (0.0, 2.0, 12), (10.0, 140.0))
    return out.select("x_bin", "y_bin", "n", r6("total").alias("total"), r6("mean").alias("mean"))


@query("""
with b as (select least(floor(value / 50.0), 9)::bigint x, least(floor(hour(ts) / 6.0), 3)::bigint y, user_id::double z from events where value >= 0 and value <= 500)
select x x_bin, y y_bin, count(*)::bigint n, round(sum(z), 6) total, round(avg(z), 6) mean from b group by x, y""")
def spectrogram_merged(spark, sf_dir):
    """Two halves counted apart and merged."""
    events = table(spark, sf_dir, "events")
    part = lambda k: S.spectrogram(events.where(F.col("event_id") % 2 == k), F.col("value"), F.hour("ts").cast("double"), F.col("user_id").cast("double"), (0.0, 50.0, 10), (0.0, 6.0, 4))
    return S.merge_spectrograms(part(0), part(1)).select("x_bin", "y_bin", "n", r6("total").alias("total"), r6("mean").alias("mean"))


_EDGES = [0.0, 50.0, 100.0, 200.0, 300.0, 500.0]


@query("""
with e as (select unnest([0, 1, 2, 3, 4]) bin, unnest([0.0, 50, 100, 200, 300]) lo, unnest([50.0, 100, 200, 300, 500]) hi)
select event_type, bin::int bin, round(sum(1.0), 6) count, round(avg(user_id::double), 6) mean, round(sqrt(sum(user_id::double * user_id)) / count(*), 6) unc
from events join e on value >= lo and value < hi group by event_type, bin""")
def rebin(spark, sf_dir):
    out = S.rebin(table(spark, sf_dir, "events"), F.col("value"), F.col("user_id").cast("double"), _EDGES, ("event_type",))
    return out.select("event_type", F.col("bin").cast("int").alias("bin"), r6("count").alias("count"), r6("mean").alias("mean"), r6("unc").alias("unc"))


@query("""
with e as (select unnest([0, 1, 2, 3, 4]) bin, unnest([0.0, 50, 100, 200, 300]) lo, unnest([50.0, 100, 200, 300, 500]) hi),
s as (select bin, greatest(least(value + 10, hi) - greatest(value - 10, lo), 0) / 20 w, user_id::double v from events, e)
select bin::int bin, round(sum(w), 6) count, round(sum(w * v) / sum(w), 6) mean, round(sqrt(sum(w * w * v * v)) / sum(w), 6) unc from s where w > 0 group by bin""")
def rebin_overlap(spark, sf_dir):
    out = S.rebin(table(spark, sf_dir, "events"), F.col("value"), F.col("user_id").cast("double"), _EDGES, delta=F.lit(10.0))
    return out.select(F.col("bin").cast("int").alias("bin"), r6("count").alias("count"), r6("mean").alias("mean"), r6("unc").alias("unc"))


@query("""
with s as (select event_type, count(*) filter (value < 123.45) lt, count(*) filter (value <= 123.45) le, count(*) n, max(value) filter (value < 123.45) b, min(value) filter (value > 123.45) a from events group by event_type)
select event_type, round(case when le = 0 then 0 when lt = n then 100 when lt = le then (lt - 1 + (123.45 - b) / (a - b)) * 100.0 / (n - 1) else (lt + le - 1) / 2.0 * 100.0 / (n - 1) end, 6) percentile from s""")
def value_percentile(spark, sf_dir):
    return S.percentile_of(table(spark, sf_dir, "events"), "value", 123.45, ("event_type",)).withColumn("percentile", r6("percentile"))


@query(weighted_sql("select event_id k, value from events", 100) + """,
m as (select rep, sum(value * w) / sum(w) stat from d join r using (k) group by rep)
select round(quantile_cont(stat, 0.05), 6) low, round(quantile_cont(stat, 0.95), 6) high from m""")
def bootstrap_ci(spark, sf_dir):
    out = S.interval(S.bootstrap(table(spark, sf_dir, "events"), "value", F.col("event_id"), 100), 90.0)
    return out.select(r6("low").alias("low"), r6("high").alias("high"))


@query("""
with e as (select l_returnflag, min(l_extendedprice) a, max(l_extendedprice) b from lineitem group by l_returnflag)
select l_returnflag, round(avg((l_extendedprice - a) / (b - a)), 6) mean, round(min((l_extendedprice - a) / (b - a)), 6) low, round(max((l_extendedprice - a) / (b - a)), 6) high from lineitem join e using (l_returnflag) group by l_returnflag""")
def normalize(spark, sf_dir):
    out = S.normalized(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ("l_returnflag",))
    return out.groupBy("l_returnflag").agg(r6(F.avg("normalized")).alias("mean"), r6(F.min("normalized")).alias("low"), r6(F.max("normalized")).alias("high"))


@query("select l_returnflag, l_linestatus, round(sqrt(sum(l_quantity * l_quantity)), 6) root, round(avg(l_quantity), 6) poisson from lineitem group by all")
def quadrature_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(r6(F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity")))).alias("root"), r6(F.avg("l_quantity")).alias("poisson"))


@query("select least(floor((l_quantity - 1) / 5.0), 9)::bigint x, least(floor(l_discount / 0.0251), 3)::bigint y, count(*)::bigint n from lineitem where l_quantity between 1 and 51 and l_discount between 0 and 0.1004 group by 1, 2")
def histogram_2d(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(S.bin_of(F.col("l_quantity"), 1.0, 5.0, 10).alias("x"), S.bin_of(F.col("l_discount"), 0.0, 0.0251, 4).alias("y"))
    return rows.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))


@query("""
with f as (select event_type, floor(value / 5) * 5 + 2.5 x, count(*)::double f from events group by 1, 2),
s as (select *, lag(x) over w px, lag(f) over w pf from f window w as (partition by event_type order by x)),
c as (select *, sum(coalesce((x - px) * (f + pf) / 2, 0)) over (partition by event_type order by x) area from s),
t as (select event_type, max(area) total from c group by 1), q as (select event_type, i, (i + 0.5) * total / 20 target from t, (select unnest(range(20)) i) where total > 0),
m as (select q.event_type, i, target, min(area) area from q join c on c.event_type = q.event_type and c.area >= q.target group by 1, 2, 3),
e as (select m.*, c.x, c.f, c.px, c.pf, target - (m.area - (c.x - c.px) * (c.f + c.pf) / 2) rest, (c.f - c.pf) / (c.x - c.px) rise from m join c on c.event_type = m.event_type and c.area = m.area)
select event_type, i::int i, round(px + 2 * rest / (pf + sqrt(pf * pf + 2 * rise * rest)), 6) x from e""")
def representative_values(spark, sf_dir):
    """Twenty values of each kind of event, spread as the counts of all its values are."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", (F.floor(F.col("value") / 5) * 5 + 2.5).alias("x")).agg(F.count("*").cast("double").alias("f"))
    return N.representative_values(counts, 20, 50.0, ("event_type",)).select("event_type", "i", r6("x").alias("x"))
