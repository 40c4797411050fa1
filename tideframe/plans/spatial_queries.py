"""Adaptive cells, nearest neighbours, regridding and values along tracks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions.timescales import utc_us
from tideframe.operators import spatial as P
from tideframe.plans.registry import Registry, r6, table

query = Registry()

HOUR = 3_600_000_000
#: Events as points: their value, and the second of their day in units of two minutes.
_POINTS = "p as (select event_id, event_type, value x, (epoch_us(ts) % 86400000000) / 120000000.0 y from events)"
_TREE = f"""with {_POINTS}, b as (select min(x) x0, min(y) y0, greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9) s from p),
f as (select event_id, floor((x - x0) / s * 67108864)::bigint fx, floor((y - y0) / s * 67108864)::bigint fy from p, b),
c as (select l, fx >> (26 - l) ix, fy >> (26 - l) iy, count(*) n from f, (select unnest(range(13)) l) group by 1, 2, 3),
k as (select l + 1 l, 2 * ix + a ix, 2 * iy + b iy from c, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b) where n > 40 and l < 12 union all select 0, 0, 0),
t as (select k.l, k.ix, k.iy, coalesce(c.n, 0) n from k left join c on c.l = k.l and c.ix = k.ix and c.iy = k.iy where coalesce(c.n, 0) <= 40 or k.l = 12)"""


def _points(spark, sf_dir):
    y = (utc_us(F.col("ts")) % (24 * HOUR)) / 120_000_000.0
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("x"), y.alias("y"))


@query(f"{_TREE}, g as (select s, x0, y0 from b) select l::int as level, ix, iy, n::bigint n, round(x0 + ix * s / pow(2, l), 6) x0, round(y0 + (iy + 1) * s / pow(2, l), 6) y1 from t, g")
def adaptive_cells(spark, sf_dir):
    """Leaves of the tree over all events with at most 40 points each."""
    tree = P.adaptive_tree(_points(spark, sf_dir), 40, 12)
    return tree.leaves().select("level", "ix", "iy", "n", r6("x0").alias("x0"), r6("y1").alias("y1"))


@query(f"{_TREE} select event_id, l::int as level, t.ix, t.iy from f join t on t.ix = fx >> (26 - l) and t.iy = fy >> (26 - l)")
def events_in_adaptive_cells(spark, sf_dir):
    points = _points(spark, sf_dir)
    return P.locate(points, P.adaptive_tree(points, 40, 12)).select("event_id", "leaf.level", "leaf.ix", "leaf.iy")


@query(f"""with {_POINTS}, d as (select a.event_id, b.event_id other, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) d from p a, p b where a.event_type = 'error' and b.event_type = 'click'),
r as (select *, row_number() over (partition by event_id order by d, other) as rank from d)
select event_id, rank::int as rank, other, round(sqrt(d), 6) distance from r where rank <= 5""")
def nearest_clicks(spark, sf_dir):
    """The five clicks nearest to each error in value and time of day."""
    points = _points(spark, sf_dir)
    errors = points.where("event_type = 'error'").select(F.col("event_id").alias("id"), "x", "y")
    clicks = points.where("event_type = 'click'").select(F.col("event_id").alias("pid"), "x", "y")
    return P.nearest_points(errors, clicks, 5, limit=64).select(F.col("id").alias("event_id"), "rank", F.col("pid").alias("other"), r6("distance").alias("distance"))


@query(f"""with {_POINTS}, q as (select event_id pid, x, y, value, user_id::double who from p join events using (event_id)),
b as (select min(x) x0, min(y) y0, ceil((max(x) - min(x)) / 20.0 - 1e-9)::bigint nx, ceil((max(y) - min(y)) / 20.0 - 1e-9)::bigint ny from q),
g as (select i, j, x0 + i * 20 gx, y0 + j * 20 gy from b, lateral (select unnest(range(nx + 1)) i), lateral (select unnest(range(ny + 1)) j)),
d as (select i, j, gx, gy, pid, value, who, (x - gx) * (x - gx) + (y - gy) * (y - gy) d from g, q), r as (select *, row_number() over (partition by i, j order by d, pid) k, min(d) over (partition by i, j) least from d),
w as (select *, case when least = 0 then (d = 0)::int else 1 / d end w from r where k <= 4)
select i, j, round(any_value(gx), 6) x, round(any_value(gy), 6) y, round(sum(w * value) / sum(w), 6) as value, round(sum(w * who) / sum(w), 6) who from w group by i, j""")
def regridded_events(spark, sf_dir):
    """Values and users of scattered events at the knots of an even grid."""
    values = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("who"))
    cells = _points(spark, sf_dir).join(values, "event_id").withColumnRenamed("event_id", "pid")
    return P.regrid(cells, ("value", "who"), 20.0, 4, limit=64).select("i", "j", *(r6(c).alias(c) for c in ("x", "y", "value", "who")))


@query("""with f as (select epoch_us(ts) // 172800000000 * 172800000000 us, event_id % 4 i, user_id % 3 j, avg(value) v, count(*)::double n from events group by 1, 2, 3),
t as (select distinct us from f), e as (select event_id, epoch_us(ts) us, value % 3 x, (user_id % 20) / 10.0 y from events),
a as (select e.*, (select max(us) from t where t.us <= e.us) a, (select min(us) from t where t.us >= e.us) b from e),
h as (select *, case when a = b then 0 else (us - a) / (b - a)::double end w, least(floor(x), 2)::bigint i, least(floor(y), 1)::bigint j from a where b is not null),
m as (select event_id, unnest([a, b]) us, unnest([1 - w, w]) w, unnest([true, a <> b]) used, i, j, x - i u, y - j v from h),
c as (select event_id, us, i + p i, j + q j, w * (case when p = 1 then u else 1 - u end) * (case when q = 1 then v else 1 - v end) w from m, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(p, q) where used),
s as (select event_id, sum(c.w * f.v) v, sum(c.w * f.n) n, count(f.v) k, count(*) of_ from c left join f on f.us = c.us and f.i = c.i and f.j = c.j group by event_id)
select event_id, round(case when k = of_ then v end, 6) mean, round(case when k = of_ then n end, 6) n from events left join s using (event_id)""")
def values_along_track(spark, sf_dir):
    """Each event as a place on a track through two-day frames of mean values."""
    events = table(spark, sf_dir, "events")
    us = utc_us(F.col("ts"))
    frame = F.timestamp_add("MICROSECOND", us - us % (48 * HOUR), F.lit("1970-01-01").cast("timestamp_ntz"))
    frames = events.groupBy(frame.alias("ts"), (F.col("event_id") % 4).alias("i"), (F.col("user_id") % 3).alias("j")).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"))
    track = events.select(F.col("event_id").alias("id"), "ts", (F.col("value") % 3).alias("x"), (F.col("user_id") % 20 / 10.0).alias("y"))
    even = lambda n: (F.lit(0.0), F.lit(1.0), F.lit(n))
    found = P.along_track(track, frames, ("mean", "n"), even(4), even(3), 48 * HOUR)
    return found.select(F.col("id").alias("event_id"), r6("mean").alias("mean"), r6("n").alias("n"))
