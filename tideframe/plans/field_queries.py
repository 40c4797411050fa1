"""Gridded fields, array reductions, resampled intervals, checks on files, and further model expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions import empirical as E
from tideframe.functions import plasma as P
from tideframe.functions.timescales import DAY_US, utc_us
from tideframe.operators import bundles as B
from tideframe.operators import fields as D
from tideframe.operators import matching as M
from tideframe.operators import rules as R
from tideframe.operators import series as N
from tideframe.operators import shape as H
from tideframe.operators import statistics as S
from tideframe.plans.registry import Registry, r6, table
from tideframe.plans.stats_queries import weighted_sql

query = Registry()
MINUTE = 60_000_000

_GRID = "select event_id, event_id // 1000 blk, (event_id // 50) % 20 y, event_id % 50 x, value u, value / 10 + user_id v, 1 + user_id / 100.0 rho from events"


def _grid(spark, sf_dir):
    """Events laid out as blocks of 20 lines of 50 points."""
    i = F.col("event_id")
    place = (F.floor(i / 1000).alias("blk"), (F.floor(i / 50) % 20).alias("y"), (i % 50).alias("x"))
    return table(spark, sf_dir, "events").select("event_id", *place, F.col("value").alias("u"), (F.col("value") / 10 + F.col("user_id")).alias("v"), (1 + F.col("user_id") / 100.0).alias("rho"))


def _slope(c: str, along: str, across: str) -> str:
    w = f"over (partition by blk, {across} order by {along})"
    return (
        f"case when lag({along}) {w} is null then -3 * {c} + 4 * lead({c}, 1) {w} - lead({c}, 2) {w} when lead({along}) {w} is null then 3 * {c} - 4 * lag({c}, 1) {w} + lag({c}, 2) {w}"
        f" else lead({c}, 1) {w} - lag({c}, 1) {w} end / 0.5"
    )


@query(f"with g as ({_GRID}) select event_id, round(({_slope('u', 'y', 'x')} - ({_slope('v', 'x', 'y')})) / 6371.0, 6) curl from g")
def vorticity(spark, sf_dir):
    return D.curl(_grid(spark, sf_dir), "u", "v", "x", "y", 0.25, ("blk",)).select("event_id", r6("curl").alias("curl"))


@query(f"""with g as ({_GRID}), s as (select *, {_slope('u', 'x', 'y')} ux, {_slope('u', 'y', 'x')} uy, {_slope('v', 'x', 'y')} vx, {_slope('v', 'y', 'x')} vy from g)
select event_id, round((u * ux + v * uy) * rho * (1000 / 6371.0) * 1.6726e-21 * 1e9, 12) fx, round((u * vx + v * vy) * rho * (1000 / 6371.0) * 1.6726e-21 * 1e9, 12) fy from s""")
def momentum_advection(spark, sf_dir):
    out = D.advection(_grid(spark, sf_dir), "u", "v", "rho", "x", "y", 0.25, ("blk",))
    return out.select("event_id", F.round("divmomx", 12).alias("fx"), F.round("divmomy", 12).alias("fy"))


@query("select date_trunc('day', ts)::date as day, round(max(value) - min(value), 6) drop from events group by 1")
def potential_drop(spark, sf_dir):
    return D.span(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "value"), "value", ("day",)).withColumn("drop", r6("drop"))


_CURRENT = "(value - 250) / 100 * sin(radians(user_id::double)) * radians(2.0) * radians(3.0) * pow(6481000.0, 2) * 1e-12"


@query(f"""select event_type, round(sum({_CURRENT}), 4) net, round(coalesce(sum({_CURRENT}) filter (value > 250), 0), 4) up, round(coalesce(sum({_CURRENT}) filter (value < 250), 0), 4) down from events group by event_type""")
def hemisphere_currents(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", ((F.col("value") - 250) / 100).alias("jr"), F.col("user_id").cast("double").alias("theta"))
    out = D.surface_currents(rows, "jr", "theta", ("event_type",), 2.0, 3.0)
    return out.select("event_type", *(F.round(c, 4).alias(c) for c in ("net", "up", "down")))


@query("""select user_id % 5 r, round(sum(pow((user_id % 5) * 6371.0, 2) * value * sin(user_id / 50.0) * 0.02 * 0.03) * 1e6 / 1e15, 6) fluence from events group by 1""")
def radial_fluence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("r"), (F.col("user_id") / 50.0).alias("theta"), F.col("value").alias("flux"))
    return D.radial_fluence(rows, "flux", "theta", "r", 0.02, 0.03).select("r", r6(F.col("fluence") / 1e15).alias("fluence"))


@query("""select event_type, user_id, round(sum(4 * pi() * 0.1 * (value - 100)) filter (value > 100), 5) omni from events where value > 100 group by all""")
def omni_from_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("flux", F.col("value") - 100)
    return D.omnidirectional(rows, "flux", F.lit(0.1), ("event_type", "user_id")).withColumn("omni", F.round("omni", 5))


@query("""
with g as (select event_id, user_id, ts, case when value > 100 then value end v from events)
select event_id, round(coalesce(last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0), 6) as value from g""")
def scrubbed_flux(spark, sf_dir):
    """Values of 100 or less count as missing; times are distinct."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 100, F.col("value")).otherwise(0.0).alias("value"))
    return D.scrubbed(rows, "value", "ts", ("user_id",)).select("event_id", r6("value").alias("value"))


_Q = "with q as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_tax) q, list(l_tax order by l_linenumber, l_quantity, l_tax) t from lineitem group by l_orderkey)"


def _lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax"))).alias("s"))
    return rows.select("l_orderkey", F.col("s.l_quantity").alias("q"), F.col("s.l_tax").alias("t"))


@query(_Q + """, v as (select *, list_filter(q, lambda x: x between 3 and 45) ok from q)
select l_orderkey, round(case when len(ok) = len(q) then list_sum(q) end, 6) total, round(list_avg(ok), 6) mean, round(sqrt(list_sum(list_transform(t, lambda x: x * x))), 6) total_unc,
 round(sqrt(list_sum(list_transform(t, lambda x: x * x))) / len(t), 6) mean_unc, list_transform(list_filter(range(1, len(q)), lambda i: (i - 1) % 2 = 0), lambda i: q[i + 1]) part from v""")
def bundle_reductions(spark, sf_dir):
    """Sums and means over one dimension by validity, their uncertainties, and a slice from the second element on by two."""
    ok = B.valid_only(F.col("q"), None, 3.0, 45.0)
    return _lists(spark, sf_dir).select(
        "l_orderkey", r6(B.total(ok)).alias("total"), r6(B.mean(ok)).alias("mean"), r6(B.total_uncertainty(F.col("t"))).alias("total_unc"), r6(B.mean_uncertainty(F.col("t"))).alias("mean_unc"),
        B.sliced(F.col("q"), 1, None, 2).alias("part"),
    )


@query("""
with e as (select vec_id, list_transform(range(9), lambda i: (1 + abs(embedding[i + 1]::double)) * sin(radians(i * 22.5))) f from embeddings)
select vec_id, round((f[1] + 4 * f[2] + 2 * f[3] + 4 * f[4] + 2 * f[5] + 4 * f[6] + 2 * f[7] + 4 * f[8] + f[9]) * radians(22.5) / 3 / 2, 6) omni from e""")
def omni_flux(spark, sf_dir):
    flux = F.transform(F.slice("embedding", 1, 9), lambda x: 1 + F.abs(x.cast("double")))
    angles = F.array(*(F.lit(22.5 * k) for k in range(9)))
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(B.omni_flux(flux, angles)).alias("omni"))


@query(_Q + """, s as (select l_orderkey, list_sort(q) q from q), c as (select *, coalesce(list_position(list_transform(q, lambda x: x >= 20), true) - 1, len(q)) a, coalesce(list_position(list_transform(q, lambda x: x >= 40), true) - 1, len(q)) b from s)
select l_orderkey, a::int low, (b - a)::int mid, (len(q) - b)::int high from c""")
def array_bin_sizes(spark, sf_dir):
    bins = B.array_bins(F.array_sort("q"), [20.0, 40.0])
    return _lists(spark, sf_dir).select("l_orderkey", *(F.size(F.get(bins, F.lit(k))).alias(n) for k, n in enumerate(("low", "mid", "high"))))


@query(weighted_sql("select event_id k, value from events", 50) + """, c as (select rep, floor(value / 100)::bigint b, sum(w) * any_value(n) / any_value(size) c from d join r using (k) join z using (rep) where value >= 0 and value < 500 group by all),
g as (select rep, b, coalesce(c, 0) c from (select unnest(range(50)) rep) cross join (select unnest(range(5)) b) left join c using (rep, b))
select b::bigint bin, (select count(*) from r where value >= 0 and floor(value / 100) = g.b)::bigint n, round(quantile_cont(c, 0.05), 6) low, round(quantile_cont(c, 0.95), 6) high from g group by b""")
def histogram_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out = S.histogram_interval(rows, "value", F.col("event_id"), 0.0, 100.0, 5, 50)
    return out.select("bin", "n", r6("low").alias("low"), r6("high").alias("high"))


_LAGS = [k * 120 * MINUTE for k in range(-2, 3)]


@query(weighted_sql("select event_id k, epoch_us(ts) t from events where event_type = 'signup'", 50) + f""", l as (select unnest([{', '.join(map(str, _LAGS))}])::bigint lag_us),
hit as (select lag_us, r.k, count(*) c from r, l join (select epoch_us(ts) b from events where event_type = 'error') on true where abs(b - t - lag_us) <= {60 * MINUTE} group by all),
t as (select l.lag_us, x.rep, coalesce(sum(w * c), 0) s from l cross join (select unnest(range(50)) rep) x left join (select hit.lag_us, d.rep, d.w * n / size w, hit.c from hit join d using (k) join z using (rep)) y on y.lag_us = l.lag_us and y.rep = x.rep group by all)
select lag_us, coalesce((select sum(c) from hit where hit.lag_us = t.lag_us), 0)::bigint total, round(quantile_cont(s, 0.025), 6) low, round(quantile_cont(s, 0.975), 6) high from t group by lag_us""")
def assoc_ci(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = M.association_interval(events.where("event_type = 'signup'"), events.where("event_type = 'error'"), "ts", ["event_id"], _LAGS, 60 * MINUTE, 50)
    return out.select("lag_us", "total", r6("low").alias("low"), r6("high").alias("high"))


@query("select event_id, (row_number() over (order by ts) - 1)::bigint as row from events")
def row_numbers(spark, sf_dir):
    """Numbers over the whole table from numbers within days; times are distinct."""
    return N.row_numbers(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"], F.floor(utc_us(F.col("ts")) / DAY_US)).select("event_id", "row")


@query("""
with s as (select *, epoch_us(ts) t, row_number() over (partition by event_type order by ts) i, count(*) over (partition by event_type) n from events),
e as (select event_id, event_type, epoch_us(ts) + 1800000000 t from events),
j as (select e.event_id, e.event_type, arg_min(s.i, abs(s.t - e.t) * 100000 + s.i) i, any_value(s.n) n from e join s using (event_type) group by e.event_id, e.event_type),
w as (select l.lag::int lag, s.value, s.user_id from j join (select unnest(range(-2, 3)) lag) l on i > 2 and i + 2 <= n join s on s.event_type = j.event_type and s.i = j.i + l.lag),
c as (select lag, unnest([0, 1, 2]) channel, unnest([value, case when user_id % 2 = 0 then value / 2 end, user_id::double]) v from w)
select lag, channel::int channel, count(*)::bigint n, round(avg(v), 6) mean, round(quantile_cont(v, 0.5), 6) median from c where v is not null group by lag, channel having count(*) >= 2""")
def sea_spectra(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    v, u = F.col("value"), F.col("user_id")
    series = events.select("event_type", "ts", F.array(v, F.when(u % 2 == 0, v / 2), u.cast("double")).alias("spectrum"))
    epochs = events.select("event_type", F.timestamp_add("MINUTE", F.lit(30), F.col("ts")).alias("ts"))
    means = M.superposed_spectra(series, epochs, "ts", "spectrum", ("event_type",), 2, {"mean": r6(F.avg("value"))}, least=2)
    middle = S.quantiles(M.superposed_cells(series, epochs, "ts", "spectrum", ("event_type",), 2), "value", {"median": 0.5}, ("lag", "channel"))
    return means.join(middle.select("lag", "channel", r6("median").alias("median")), ["lag", "channel"])


@query("""with b as (select min(ts) a, max(ts) z from events where event_type = 'view') select event_id from events, b where event_type = 'error' and ts between a + interval 6 hour and z - interval 6 hour""")
def epochs_within(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return M.epochs_within(events.where("event_type = 'error'"), events.where("event_type = 'view'"), "ts", 360 * MINUTE).select("event_id")


@query("select event_id, round(value, 6) as value from events where ts > '2024-01-05 00:00:00' and ts < '2024-01-20 12:00:00' and event_type = 'signup' and user_id = 3")
def events_between(spark, sf_dir):
    out = M.events_between(table(spark, sf_dir, "events"), "ts", "2024-01-05 00:00:00", "2024-01-20 12:00:00", {"event_type": "signup", "user_id": 3})
    return out.select("event_id", r6("value").alias("value"))


@query("""with g as (select event_type, 1 + 25.0 * least(greatest(ceil((value - 1) / 25.0 - 0.5), 0), 15) l, user_id from events) select event_type, round(l, 6) l, round(avg(user_id), 6) as mean, count(*)::bigint n from g group by event_type, l""")
def grid_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("l"), F.col("user_id").alias("mean"))
    return S.grid_means(rows, "l", "mean", 1.0, 25.0, 16, ("event_type",)).select("event_type", r6("l").alias("l"), r6("mean").alias("mean"), "n")


@query("""with d as (select event_type, event_type || '_' || strftime(make_timestamp((epoch_us(ts) // 172800000000 * 172800000000)::bigint), '%Y%m%d') || '.cdf' path, ts from events)
select path, count(distinct ts::date)::bigint as days, case when count(distinct ts::date) > 1 then 'several days' else 'another day' end as message from d group by path
 having count(distinct ts::date) > 1 or min(strftime(ts, '%Y%m%d')) <> regexp_extract(path, '[0-9]{8}')""")
def file_days(spark, sf_dir):
    """Files of two days each, named after the first one."""
    us = utc_us(F.col("ts"))
    start = F.timestamp_add("MICROSECOND", us - us % (2 * DAY_US), F.lit("1970-01-01").cast("timestamp_ntz"))
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_"), F.date_format(start, "yyyyMMdd"), F.lit(".cdf")).alias("path"), "ts")
    return R.wrong_file_days(rows, "path", "ts")


@query("""
with s as (select event_type, min(ts) a, max(ts) b from events group by event_type)
select event_type, unnest(generate_series(a, b, interval 90 minute)) ts from s""")
def tick_range(spark, sf_dir):
    """Every 90 minutes from the first to the last time of each kind of event."""
    spans = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return H.ticks_between(spans, "a", "b", 5_400_000_000, out="ts").select("event_type", "ts")


@query("""
with recursive g as (select 0 i, 0.1::double low, 0.03::double width union all select i + 1, low + width, width * 1.27 from g where i < 40)
select event_id, i::bigint as bin from events left join g on value + 0.0037 >= low and value + 0.0037 < low + width""")
def energy_grid(spark, sf_dir):
    """The energy bin of each event's value; the SQL adds up the widths."""
    return table(spark, sf_dir, "events").select("event_id", E.energy_bin(F.col("value") + 0.0037).alias("bin"))


@query("""
with f as (select event_id, 1 + value / 10 b, 1 + user_id / 10.0 rho, value speed, user_id * 1.5 theta, value / 80 phi from events),
w as (select *, sqrt(4 * pi() * (rho / 3.1 * 1e6) * (pow(1.6022e-19, 2) / (3.1 * 1.6276e-27))) w from f)
select event_id, round(w, 4) plasma, round(sqrt(speed * speed + 900) * 1000 * 3.1 * 1.6276e-27 / (1.6022e-19 * b * 1e-9) / 6378000, 6) gyro,
 round(1e3 * b * 1e-12 / sqrt(rho * 4e-7 * pi() * 1.6726e-27 * 1e6) / w / 6378000, 6) inertia, round(speed * sin(theta) * cos(phi) + 20 * sin(theta) * sin(phi) - 10 * cos(theta), 6) radial,
 round(sqrt(2 * speed * 1.602176634e-19 / 1.6726e-27), 2) ion, round(0.5 * 1.6726e-27 * pow(speed * 1000, 2) / 1.602176634e-19, 4) energy, round(20 * cos(radians(theta)) - speed * sin(radians(theta)), 6) azimuthal from w""")
def ion_scales(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    b, rho, theta, phi = 1 + v / 10, 1 + u / 10.0, u * 1.5, v / 80
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(P.plasma_frequency(rho), 4).alias("plasma"), r6(P.gyroradius(b, v, F.lit(30.0))).alias("gyro"), r6(1e3 * P.inertial_length(b, rho)).alias("inertia"),
        r6(P.radial_speed((v, F.lit(20.0), F.lit(-10.0)), theta, phi)).alias("radial"), F.round(P.ion_speed(v), 2).alias("ion"), F.round(P.ion_energy(v * 1000), 4).alias("energy"),
        r6(P.azimuthal_current(v, F.lit(20.0), theta)).alias("azimuthal"),
    )


@query("""
with f as (select event_id, value omni, (user_id % 90) + 0.5 alpha, 2 + user_id % 7 n, 3 + value / 100 l, user_id % 9 kp from events)
select event_id, round(omni / (2 * pi() * (sqrt(pi()) * gamma((n + 2) / 2.0) / gamma((n + 3) / 2.0))) * pow(sin(radians(alpha)), n), 6) flux, round(1e8 * 1e-8 * exp(-pow(l - 5, 2) / 0.5), 6) source, round(3 * exp(-pow(l - 5.6, 2) / (2 * 0.09)) * kp * kp, 6) accel from f""")
def radiation_sources(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    shell = 3 + v / 100
    return table(spark, sf_dir, "events").select(
        "event_id", r6(E.sine_flux(v, (u % 90) + 0.5, (2 + u % 7).cast("double"))).alias("flux"), r6(1e8 * E.gaussian_source(shell)).alias("source"), r6(E.local_acceleration(shell, u % 9, 3.0)).alias("accel")
    )


@query("select x_bin, y_bin, n, round(mean, 6) mean from (select least(floor(value / 50.0), 9)::bigint x_bin, least(floor(hour(ts) / 6.0), 3)::bigint y_bin, count(*)::bigint n, avg(user_id) mean from events where value between 0 and 500 group by 1, 2) where x_bin = 4")
def spectrogram_slice(spark, sf_dir):
    edges = (0.0, 50.0, 10)
    cells = S.spectrogram(table(spark, sf_dir, "events"), F.col("value"), F.hour("ts").cast("double"), F.col("user_id").cast("double"), edges, (0.0, 6.0, 4))
    return S.spectrogram_slice(cells, 230.0, "x_bin", edges).select("x_bin", "y_bin", "n", r6("mean").alias("mean"))
