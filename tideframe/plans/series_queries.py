"""Windows, gaps, derivatives and sessions over the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions.timescales import DAY_US, utc_us
from tideframe.operators import series as S
from tideframe.plans.registry import Registry, r6, table

query = Registry()
HOUR = 3_600_000_000


def _window_sql(width: int, hop: int, key: str, first: str = "min(epoch_us(ts))") -> str:
    k = f"{key}, " if key else ""
    join = f"e.{key} = g.{key} and " if key else ""
    return f"""
with b as (select {k}{first} f, max(epoch_us(ts)) l from events {f'group by {key}' if key else ''}),
g as (select {k}f + k * {hop} s from (select {k}f, unnest(range(0, case when l > f then (l - f - 1) // {hop} + 1 else 0 end)) k from b))
select {f'g.{key}, ' if key else ''}make_timestamp((s + {width // 2})::bigint) as label, round(avg(value), 6) as value
from g left join events e on {join}epoch_us(e.ts) >= s and epoch_us(e.ts) < s + {width} group by {f'g.{key}, ' if key else ''}s"""


@query(_window_sql(HOUR, HOUR, ""))
def window_mean_hourly(spark, sf_dir):
    return S.window_mean(table(spark, sf_dir, "events"), "ts", "value", HOUR).withColumn("value", r6("value"))


@query(_window_sql(DAY_US, DAY_US // 2, "event_type"))
def window_mean_overlap(spark, sf_dir):
    return S.window_mean(table(spark, sf_dir, "events"), "ts", "value", DAY_US, DAY_US // 2, ("event_type",)).withColumn("value", r6("value"))


@query(_window_sql(6 * HOUR, 6 * HOUR, "event_type", f"min(epoch_us(ts)) // {DAY_US} * {DAY_US}"))
def resample_multi(spark, sf_dir):
    """Resampling starts at the midnight before each series' first sample."""
    events = table(spark, sf_dir, "events")
    midnight = F.floor(F.col("first") / DAY_US).cast("long") * DAY_US
    return S.window_mean(events, "ts", "value", 6 * HOUR, 0, ("event_type",), start=midnight).withColumn("value", r6("value"))


@query(_window_sql(DAY_US, DAY_US, "event_type").replace("avg(value)", "max(value)"))
def window_max_daily(spark, sf_dir):
    return S.window_mean(table(spark, sf_dir, "events"), "ts", "value", DAY_US, 0, ("event_type",), op=F.max).withColumn("value", r6("value"))


@query("""
with s as (select user_id, ts, value, lead(epoch_us(ts)) over (partition by user_id order by ts) - epoch_us(ts) step from events),
m as (select user_id, quantile_cont(step, 0.5) * 1.5 most from s where step is not null group by user_id)
select user_id, ts, round(value, 6) as value from events
union all select s.user_id, make_timestamp((epoch_us(ts) + step // 2)::bigint), null from s join m using (user_id) where step > most""")
def gap_fill(spark, sf_dir):
    return S.gap_fill(table(spark, sf_dir, "events"), "ts", "value", ("user_id",)).select("user_id", "ts", r6("value").alias("value"))


@query("""
with s as (select *, lag(value) over w x1, lag(value, 2) over w x2, lead(value) over w y1, lead(value, 2) over w y2,
 epoch_us(ts) t, epoch_us(lag(ts) over w) t1, epoch_us(lag(ts, 2) over w) t2, epoch_us(lead(ts) over w) u1, epoch_us(lead(ts, 2) over w) u2
 from events window w as (partition by user_id order by ts))
select event_id, round(case when x1 is null then (-y2 + 4 * y1 - 3 * value) / ((u2 - t) / 1e6) when y1 is null then (3 * value - 4 * x1 + x2) / ((t - t2) / 1e6)
 else (y1 - x1) / ((u1 - t1) / 1e6) end, 6) rate from s""")
def rate_of_change(spark, sf_dir):
    return S.derivative(table(spark, sf_dir, "events"), "ts", "value", ("user_id",)).select("event_id", r6("rate").alias("rate"))


@query("""
with g as (select l_orderkey, l_linenumber, max(l_extendedprice) x from lineitem group by l_orderkey, l_linenumber),
s as (select *, lag(x) over w a, lead(x) over w b, lag(l_linenumber) over w p, lead(l_linenumber) over w q from g window w as (partition by l_orderkey order by l_linenumber))
select l_orderkey, l_linenumber, round(case when p is null then (b - x) / nullif(q - l_linenumber, 0) when q is null then (x - a) / nullif(l_linenumber - p, 0)
 else (b - a) / nullif(q - p, 0) end, 4) slope from s""")
def line_gradient(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("x"))
    return S.gradient(rows, "l_linenumber", "x", ("l_orderkey",)).select("l_orderkey", "l_linenumber", F.round("slope", 4).alias("slope"))


@query("select event_id, (dense_rank() over (partition by event_type order by value) - 1)::int step from events")
def values_to_steps(spark, sf_dir):
    return S.values_to_steps(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", ("event_type",)).select("event_id", "step")


@query("""
select event_id, ts from (select *, lag(ts) over (partition by event_type order by value, event_id) b from events) where ts < b""")
def out_of_order(spark, sf_dir):
    """Records of each type in order of their value, numbered and compared in buckets of values and of numbers."""
    rows = S.row_numbers(table(spark, sf_dir, "events"), ["value", "event_id"], F.floor(F.col("value") / 10), "record", ("event_type",))
    return S.out_of_order(rows, "ts", "record", ("event_type",), F.floor(F.col("record") / 100_000)).select("event_id", "ts")


@query("""
with recursive n as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts) i from events),
k as (select user_id, ts, event_id, 1::bigint i from n where i = 1
 union all select n.user_id, n.ts, n.event_id, n.i from k join n on n.user_id = k.user_id and n.i = (select min(m.i) from n m where m.user_id = k.user_id and m.i > k.i and epoch_us(m.ts) > epoch_us(k.ts) + 14400000000))
select event_id, user_id, ts from k""")
def refractory(spark, sf_dir):
    return S.refractory(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", 4 * HOUR, ("user_id",))


@query("""
with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) > interval 30 minute then 1 else 0 end new from events),
t as (select *, sum(new) over (partition by user_id order by ts) g from s)
select user_id, epoch_us(min(ts))::bigint first_us, epoch_us(max(ts))::bigint last_us, count(*)::bigint n from t group by user_id, g""")
def sessions(spark, sf_dir):
    out = S.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ("user_id",))
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@query("""
select event_id, round(last_value(case when value > 400 then value end ignore nulls) over (partition by event_type order by ts rows unbounded preceding), 6) held from events""")
def last_valid_value(spark, sf_dir):
    """Values at or under 400 are replaced by the last one above, with a hot key cut into days."""
    rows = table(spark, sf_dir, "events").withColumn("us", utc_us(F.col("ts")))
    out = S.carried(rows, ("event_type",), "us", {"held": F.when(F.col("value") > 400, F.col("value"))}, bucket=F.floor(F.col("us") / DAY_US))
    return out.select("event_id", r6("held").alias("held"))


@query("""
with n as (select event_type, value, row_number() over (partition by event_type order by ts) - 1 i from events),
w as (select event_type, value, unnest(range(greatest(0, floor((i - 50) / 25.0) + 1)::bigint, (i // 25 + 1)::bigint)) k from n)
select event_type, k::bigint as k, round(avg(value), 6) mean from w group by event_type, k having count(*) = 50""")
def point_window_mean(spark, sf_dir):
    """Windows of 50 samples that overlap by 25."""
    rows = S.row_numbers(table(spark, sf_dir, "events"), ["ts"], F.floor(utc_us(F.col("ts")) / DAY_US), "i", ("event_type",)).select("event_type", "value", "i")
    k = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - 50) / 25).cast("int") + 1), F.floor(F.col("i") / 25).cast("int")))
    out = rows.select("event_type", "value", k.alias("k")).groupBy("event_type", "k").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.where("n = 50").select("event_type", F.col("k").cast("long").alias("k"), r6("mean").alias("mean"))
