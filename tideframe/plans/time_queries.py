"""Time systems over event and order times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions import timescales as T
from tideframe.plans.registry import Registry, r6, table

query = Registry()
_LEAPS = "(values " + ", ".join(f"(timestamp '{d}', {k + 1})" for k, d in enumerate(T.LEAP_DAYS)) + ") l(d, n)"


def _leap_sql(ts: str) -> str:
    return f"(select coalesce(max(n), 0)::bigint from {_LEAPS} where d <= {ts})"


@query(f"""
with e as (select event_id, ts, epoch_us(ts) us, {_leap_sql('ts')} leap from events)
select event_id, leap::bigint leapsecs, (us + (leap + {T.TAI_1970}) * 1000000)::bigint tai_us, round(us / 1e6, 6) unx,
 round((us + (leap + {T.TAI_1970}) * 1000000) / 1e6 - {T.GPS_TAI}, 6) gps, floor(us / 1e3 + {T.CDF_1958_MS + T.TAI_1970 * 1000}.0)::bigint cdf_ms,
 ((us + (leap + {T.TAI_1970}) * 1000000 - {(946728000 + T.TAI_1970) * 1000000}) * 1000 + 32184000000)::bigint tt2000
from e""")
def time_systems(spark, sf_dir):
    us = F.col("us")
    return table(spark, sf_dir, "events").select("event_id", T.utc_us(F.col("ts")).alias("us")).select(
        "event_id", T.leap_seconds(us).alias("leapsecs"), T.tai_us(us).alias("tai_us"), r6(T.unix_seconds(us)).alias("unx"), r6(T.gps_seconds(us)).alias("gps"),
        F.floor(T.cdf_ms(us)).alias("cdf_ms"), T.tt2000_ns(us).alias("tt2000"),
    )


@query(f"""
with e as (select o_orderkey, o_orderdate ts, epoch_us(o_orderdate) + {(T.TAI_1970 - 43200) * 1000000} since from orders),
d as (select *, (since // 86400000000)::bigint as day, since % 86400000000 as inside from e),
j as (select *, exists(select 1 from {_LEAPS} where epoch_us(d) = (day + 1) * 86400000000 - {T.TAI_1970 * 1000000}) leap from d)
select o_orderkey, round(day + case when leap then (inside + case when inside >= 43200000000 then 1000000 else 0 end) / 86401e6 else inside / 86400e6 end + 2436205.0, 6) jd,
 round(day + case when leap then (inside + case when inside >= 43200000000 then 1000000 else 0 end) / 86401e6 else inside / 86400e6 end + 36204.5, 6) mjd,
 round(epoch_us(ts) / 86400e6 + 719163.0, 6) rdt from j""")
def julian_days(spark, sf_dir):
    us = T.utc_us(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(T.julian_date(us)).alias("jd"), r6(T.modified_julian_date(us)).alias("mjd"), r6(T.ordinal_day(us)).alias("rdt"))


@query("""
select event_id, dayofyear(ts)::int doy, round(dayofyear(ts) - 1 + (epoch_us(ts) % 86400000000) / 86400e6, 6) edoy, strftime(ts, '%Y-%m-%dT%H:%M:%S') iso,
 ((year(ts) % 4 = 0 and year(ts) % 100 <> 0) or year(ts) % 400 = 0) leap_year from events""")
def day_of_year(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.dayofyear(ts).alias("doy"), r6(T.fractional_day_of_year(ts)).alias("edoy"), T.iso(ts).alias("iso"), T.is_leap_year(F.year(ts)).alias("leap_year"))


@query(f"""
with o as (select o_orderkey, epoch_us(o_orderdate) us, {_leap_sql('o_orderdate')} leap, lead(epoch_us(o_orderdate)) over w nxt,
 lead({_leap_sql('o_orderdate')}) over w nleap from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, ((nxt + nleap * 1000000) - (us + leap * 1000000))::bigint elapsed_us from o where nxt is not null""")
def leap_aware_diff(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", T.tai_us(T.utc_us(F.col("o_orderdate"))).alias("tai"))
    return rows.select("o_orderkey", (F.lead("tai").over(w) - F.col("tai")).alias("elapsed_us")).where("elapsed_us is not null")


@query("""
select event_id, floor(date_diff('microsecond', timestamp '1853-11-09 21:38:44.160000', ts) / (27.2753 * 86400e6) + 1)::bigint carrington,
 floor(date_diff('microsecond', timestamp '1832-02-08 00:00:00', ts) / (27.0 * 86400e6) + 1)::bigint bartels from events""")
def solar_rotations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.solar_rotation(F.col("ts")).alias("carrington"), T.solar_rotation(F.col("ts"), "bartels").alias("bartels"))


@query(f"""select event_id, epoch_us(ts)::bigint utc_us from events""")
def time_round_trip(spark, sf_dir):
    """TAI and TT2000 back to UTC give the microseconds they came from."""
    rows = table(spark, sf_dir, "events").select("event_id", T.utc_us(F.col("ts")).alias("us"))
    rows = rows.select("event_id", T.tai_us(F.col("us")).alias("tai"), T.tt2000_ns(F.col("us")).alias("tt"))
    rows = rows.select("event_id", T.utc_us_of_tai(F.col("tai")).alias("back"), T.tai_us_of_tt2000(F.col("tt")).alias("tai"))
    return rows.select("event_id", F.when(F.col("back") == T.utc_us_of_tai(F.col("tai")), F.col("back")).alias("utc_us"))


@query("""
select event_id, (epoch_us(ts) // 1000000 + 62167219200)::double s, ((epoch_us(ts) % 1000000) * 1000000)::double ps, floor((epoch_us(ts) // 1000000 + 62167219200)::double * 1000 + ((epoch_us(ts) % 1000000) * 1000000)::double / 1e9)::bigint ms from events""")
def epoch16_pairs(spark, sf_dir):
    e = T.epoch16(T.utc_us(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", e.alias("e")).select("event_id", "e.s", "e.ps", F.floor(T.epoch16_to_ms(F.col("e"))).alias("ms"))


@query("""
select p_partkey, (date '2024-01-01' + (p_partkey % 366)::int)::date as day, ((p_size * 3661) % 86400 // 3600)::int h, ((p_size * 3661) % 3600 // 60)::int m, ((p_size * 3661) % 60)::int s from part""")
def doy_and_hms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hms = T.hms((F.col("p_size") * 3661).cast("double"))
    return part.select("p_partkey", T.day_of_year_to_date(F.lit(2024), F.col("p_partkey") % 366 + 1).alias("day"), hms.alias("t")).select("p_partkey", "day", "t.h", "t.m", "t.s")


@query("""
with d as (select unnest(generate_series((select min(o_orderdate) from orders), (select max(o_orderdate) from orders), interval 1 day)) as day)
select d.day, count(o_orderkey)::bigint n from d left join orders o on o.o_orderdate >= d.day and o.o_orderdate < d.day + interval 1 day group by d.day""")
def tickrange_join(spark, sf_dir):
    """A regular grid of times from the first to the last order; empty days stay."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ends = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    k = F.floor(F.timestamp_diff("MICROSECOND", F.col("a"), F.col("o_orderdate")) / T.DAY_US)
    counted = orders.crossJoin(F.broadcast(ends)).groupBy(k.alias("k"), "a").agg(F.count("*").alias("n")).select(F.timestamp_add("DAY", F.col("k"), F.col("a")).alias("day"), "n")
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
with t as (select o_orderkey, o_orderdate::timestamp as read, (o_orderdate + interval 100 day)::timestamp as last, (o_orderdate + interval (o_orderkey % 1200) day)::timestamp as now from orders),
h as (select *, make_timestamp(year(read) + 1, case when month(read) > 6 then 7 else 1 end, 1, 0, 0, 0) a, date_trunc('year', last) + case when month(last) > 6 then interval 12 month else interval 6 month end b from t)
select o_orderkey, greatest(a, b)::timestamp as until, now < greatest(a, b) as current from h""")
def leap_lists(spark, sf_dir):
    """Lists of leap seconds published on each order's day, the last leap 100 days after it, used some days later."""
    days = lambda n: F.timestamp_add("DAY", n, F.col("read"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("read"))
    rows = rows.withColumns({"last": days(F.lit(100)), "now": days((F.col("o_orderkey") % 1200).cast("int"))})
    args = (F.col("read"), F.col("last"))
    return rows.select("o_orderkey", T.leaps_known_until(*args).alias("until"), T.leaps_current(F.col("now"), *args).alias("current"))
