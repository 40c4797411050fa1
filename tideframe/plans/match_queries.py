"""Joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions.timescales import DAY_US, utc_us
from tideframe.operators import boundaries as L
from tideframe.operators import matching as M
from tideframe.operators import statistics as S
from tideframe.plans.registry import Registry, r6, table

query = Registry()
MINUTE = 60_000_000


def _kind(spark, sf_dir, kind: str):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("""
select event_id, round(value, 6) as value from events where event_type = 'click' and ts between (select min(ts) from events where event_type = 'error')
 and (select max(ts) from events where event_type = 'error')""")
def t_overlap(spark, sf_dir):
    out = M.overlap(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "error"), "ts")
    return out.select("event_id", r6("value").alias("value"))


@query("""select o_orderkey, (o_orderdate in (select l_shipdate from lineitem where l_quantity > 45)) shared from orders""")
def t_common(spark, sf_dir):
    ships = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_shipdate").alias("o_orderdate"))
    return M.common(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ships, "o_orderdate", mark="shared").select("o_orderkey", "shared")


@query("""select o_orderkey from orders where o_orderdate in (select l_shipdate from lineitem where l_quantity > 45)""")
def t_common_rows(spark, sf_dir):
    ships = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_shipdate").alias("o_orderdate"))
    return M.common(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ships, "o_orderdate").select("o_orderkey")


@query("""
select p.event_id, round(c.value, 6) as value from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts""")
def asof_last_click(spark, sf_dir):
    out = M.as_of(_kind(spark, sf_dir, "purchase").select("event_id", "user_id", "ts"), _kind(spark, sf_dir, "click"), "ts", ("user_id",), ("value",))
    return out.select("event_id", r6("value").alias("value"))


@query("""
select p.event_id, round(c.value, 6) as value from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'error') c on p.ts >= c.ts""")
def asof_any_error(spark, sf_dir):
    """No equality at all: one series, cut into days."""
    left = _kind(spark, sf_dir, "purchase").select(F.lit(0).alias("g"), "event_id", "ts")
    right = _kind(spark, sf_dir, "error").select(F.lit(0).alias("g"), "ts", "value")
    return M.as_of(left, right, "ts", ("g",), ("value",), bucket_us=DAY_US).select("event_id", r6("value").alias("value"))


@query("""
with p as (select * from events where event_type = 'purchase'), c as (select * from events where event_type = 'click'),
n as (select p.event_id, epoch_us(p.ts) t, (select max(epoch_us(ts)) from c where c.user_id = p.user_id and c.ts <= p.ts) a, (select min(epoch_us(ts)) from c where c.user_id = p.user_id and c.ts >= p.ts) b from p)
select event_id, (case when a is null then b - t when b is null then t - a else least(t - a, b - t) end)::bigint distance_us from n""")
def nearest_event(spark, sf_dir):
    out = M.nearest(_kind(spark, sf_dir, "purchase").select("event_id", "user_id", "ts"), _kind(spark, sf_dir, "click"), "ts", ("user_id",), ("value",))
    return out.select("event_id", "distance_us")


def _around_sql(value: str) -> str:
    return f"""
with p as (select * from events where event_type = 'purchase'), c as (select user_id, epoch_us(ts) t, value from events where event_type = 'view'),
a as (select p.event_id, epoch_us(p.ts) t, p.user_id, p.ts, c.t t0, c.value v0 from p asof left join c on p.user_id = c.user_id and epoch_us(p.ts) >= c.t),
b as (select a.*, c.t t1, c.value v1 from a asof left join c on a.user_id = c.user_id and a.t <= c.t)
select event_id, {value} as value from b"""


@query(_around_sql("round(case when t0 = t1 then v0 else v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) end, 6)"))
def interp_value(spark, sf_dir):
    out = M.interpolate(_kind(spark, sf_dir, "purchase").select("event_id", "user_id", "ts"), _kind(spark, sf_dir, "view"), "ts", ("user_id",), "value")
    return out.select("event_id", r6("value").alias("value"))


_S, _C = (f"case when t0 = t1 then {f}(v0 * pi() / 180) else {f}(v0 * pi() / 180) + ({f}(v1 * pi() / 180) - {f}(v0 * pi() / 180)) * ((t - t0) / (t1 - t0)) end" for f in ("sin", "cos"))


@query(_around_sql(f"round(((atan2({_S}, {_C}) * 180 / pi()) + 360) % 360, 5)"))
def interp_circular(spark, sf_dir):
    out = M.interpolate(_kind(spark, sf_dir, "purchase").select("event_id", "user_id", "ts"), _kind(spark, sf_dir, "view"), "ts", ("user_id",), "value", period=360.0)
    return out.select("event_id", F.round("value", 5).alias("value"))


@query("""
select p.event_id, round(max(c.value), 6) most from (select * from events where event_type = 'error') p
left join events c on c.event_type = 'click' and c.ts between p.ts - interval 3 hour and p.ts group by p.event_id""")
def interval_max(spark, sf_dir):
    out = M.interval_max(_kind(spark, sf_dir, "error"), _kind(spark, sf_dir, "click"), "ts", "value", 180 * MINUTE, "event_id")
    return out.select("event_id", r6("value").alias("most"))


_LAGS = [k * 30 * MINUTE for k in range(-4, 5)]


@query(f"""
with l as (select unnest([{', '.join(map(str, _LAGS))}])::bigint lag_us), a as (select epoch_us(ts) t from events where event_type = 'signup'), b as (select epoch_us(ts) t from events where event_type = 'error'),
e as (select lag_us, greatest((select min(t) from a) + lag_us, (select min(t) from b)) - 900000000 s0, least((select max(t) from a) + lag_us, (select max(t) from b)) + 900000000 s1 from l)
select lag_us, (select count(*) from a, b where abs(b.t - a.t - lag_us) <= 900000000)::bigint total,
 round(2.0 * (select count(*) from a where t between s0 - lag_us and s1 - lag_us) * (select count(*) from b where t between s0 and s1) * 900000000 / (s1 - s0), 6) expected from e""")
def assoc_counts(spark, sf_dir):
    out = M.association(_kind(spark, sf_dir, "signup"), _kind(spark, sf_dir, "error"), "ts", _LAGS, 15 * MINUTE)
    return out.select("lag_us", "total", r6("expected").alias("expected"))


_SEA = """
with s as (select event_type, epoch_us(ts) t, value, row_number() over (partition by event_type order by ts) i, count(*) over (partition by event_type) n from events),
e as (select event_id, event_type, epoch_us(ts) + 1800000000 t from events),
j as (select e.event_id, e.event_type, arg_min(s.i, abs(s.t - e.t) * 100000 + s.i) i, any_value(s.n) n from e join s using (event_type) group by e.event_id, e.event_type),
w as (select l.lag::int lag, s.value from j join (select unnest(range(-3, 4)) lag) l on i > 3 and i + 3 <= n join s on s.event_type = j.event_type and s.i = j.i + l.lag)
"""


def _sea(spark, sf_dir, aggregates):
    events = table(spark, sf_dir, "events")
    epochs = events.select("event_type", F.timestamp_add("MINUTE", F.lit(30), F.col("ts")).alias("ts"))
    return M.superposed_epochs(events.select("event_type", "ts", "value"), epochs, "ts", "value", ("event_type",), 3, aggregates)


@query(_SEA + "select lag, count(*)::bigint n, round(avg(value), 6) mean from w group by lag")
def sea_mean(spark, sf_dir):
    return _sea(spark, sf_dir, {"n": F.count("*"), "mean": r6(F.avg("value"))})


@query(_SEA + "select lag, round(quantile_cont(value, 0.25), 6) q25, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75 from w group by lag")
def sea_quartiles(spark, sf_dir):
    found = S.quantiles(_sea(spark, sf_dir, None), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ("lag",))
    return found.select("lag", *(r6(c).alias(c) for c in ("q25", "q50", "q75")))


@query(_SEA + ", m as (select lag, quantile_cont(value, 0.5) med from w group by lag) select lag, round(any_value(med), 6) med, round(quantile_cont(abs(value - med), 0.5), 6) mad from w join m using (lag) group by lag")
def sea_mad(spark, sf_dir):
    found = S.median_absolute_deviation(_sea(spark, sf_dir, None), "value", ("lag",))
    return found.select("lag", r6("median").alias("med"), r6("mad").alias("mad"))


def _pause_sql(model: str, hours: int, lpp: str) -> str:
    return f"""select e.event_id, '{model}' as model, round(any_value({lpp}), 6) lpp from (select * from events where event_type = 'error') e
 left join (select ts, value / 61.7 kp from events where event_type = 'click') c on c.ts between e.ts - interval {hours} hour and e.ts group by e.event_id"""


_SECTOR = "case when any_value(e.user_id) % 24 in (0, 1, 2, 21, 22, 23) then 5.7 - 0.42 * max(kp) when any_value(e.user_id) % 24 < 9 then 6.05 - 0.573 * max(kp) when any_value(e.user_id) % 24 < 15 then 5.2 - 0.425 * max(kp) else 4.45 - 0.167 * max(kp) end"


@query(" union all ".join(_pause_sql(m, h, x).replace("any_value(" + x + ")", x) for m, h, x in (("CA1992", 24, "5.6 - 0.46 * max(kp)"), ("M2002", 12, "5.39 - 0.382 * max(kp)"), ("RT1970", 0, "5.64 - 0.78 * sqrt(max(kp))"), ("M2002 by local time", 12, _SECTOR))))
def plasmapause(spark, sf_dir):
    """The plasmapause at each error by three models, from the largest index of their prior hours, and by local time."""
    ticks = _kind(spark, sf_dir, "error").select("event_id", "ts", "user_id")
    index = _kind(spark, sf_dir, "click").select("ts", (F.col("value") / 61.7).alias("kp"))
    out = None
    for model, name, lt in (("CA1992", "CA1992", None), ("M2002", "M2002", None), ("RT1970", "RT1970", None), ("M2002", "M2002 by local time", F.col("user_id") % 24 + 0.5)):
        found = L.plasmapause(ticks, index, "ts", "kp", "event_id", model, lt).select("event_id", F.lit(name).alias("model"), r6("lpp").alias("lpp"))
        out = found if out is None else out.unionByName(found)
    return out
