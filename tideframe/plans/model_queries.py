"""Vectors, indices, plasma and empirical expressions, times as text, arrays and fields that other modules don't hold."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideframe.functions import empirical as E
from tideframe.functions import frames
from tideframe.functions import geodesy as G
from tideframe.functions import plasma as P
from tideframe.functions import timescales as T
from tideframe.functions import vectors as V
from tideframe.operators import bundles as B
from tideframe.operators import fields as D
from tideframe.operators import iterative as I
from tideframe.operators import matching as M
from tideframe.operators import rules as R
from tideframe.operators import shape as H
from tideframe.operators import statistics as S
from tideframe.plans.registry import Registry, r6, rounded, table
from tideframe.sources import text as X

query = Registry()


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""
with e as (select event_id, 1 + value / 100 r, user_id % 181 - 90 lat, event_id % 360 - 180 lon from events)
select event_id, round(r * cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 x, round(r * cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 y, round(r * sin(radians(lat)), 6) + 0.0 z from e""")
def spherical_to_cartesian(spark, sf_dir):
    s = V.sph2car(1 + F.col("value") / 100, F.col("user_id") % 181 - 90, F.col("event_id") % 360 - 180)
    return _events(spark, sf_dir).select("event_id", s.alias("s")).select("event_id", *((r6(f"s.{c}") + 0.0).alias(c) for c in "xyz"))


@query("""
with e as (select event_id, 1 + value r, (event_id % 628) / 100.0 - 3.14 a from events)
select event_id, round(r * cos(a), 6) x, round(r * sin(a), 6) y, round(r, 6) radius, round(a, 6) angle from e""")
def polar_round_trip(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", V.polar2cart(1 + F.col("value"), (F.col("event_id") % 628) / 100.0 - 3.14).alias("c"))
    rows = rows.select("event_id", "c", V.cart2polar(F.col("c.x"), F.col("c.y")).alias("p"))
    return rows.select("event_id", r6("c.x").alias("x"), r6("c.y").alias("y"), r6("p.r").alias("radius"), r6("p.theta").alias("angle"))


@query("""
with q as (select vec_id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, embedding[4]::double w from embeddings),
u as (select vec_id, x / n x, y / n y, z / n z, w / n w from (select *, sqrt(x * x + y * y + z * z + w * w) n from q)),
s as (select *, greatest(abs(x), abs(y), abs(z), abs(w)) m from u),
t as (select *, case when abs(w) = m then sign(w) when abs(x) = m then sign(x) when abs(y) = m then sign(y) else sign(z) end g from s)
select vec_id, round(-x, 5) cx, round(w, 5) cw, round(1 - 2 * (y * y + z * z), 5) m11, round(2 * (x * y - z * w), 5) m12, round(2 * (x * z + y * w), 5) m13, round(2 * (y * z - x * w), 5) m23,
 round(x * g, 5) bx, round(y * g, 5) as by_, round(z * g, 5) bz, round(w * g, 5) bw from t""")
def quaternion_matrices(spark, sf_dir):
    """Conjugates, matrices, and quaternions found again from the matrices."""
    q = V.quat_normalize(tuple(F.col("embedding")[k].cast("double") for k in range(4)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(n) for c, n in zip(q, "xyzw", strict=True)))
    q = tuple(F.col(n) for n in "xyzw")
    conjugate = V.quat_conjugate(q)
    rows = rows.select("vec_id", conjugate[0].alias("cx"), conjugate[3].alias("cw"), V.quat_to_matrix(q, False).alias("m"))
    back = V.quat_from_matrix([[F.col("m")[i][j] for j in range(3)] for i in range(3)])
    cells = {"m11": (0, 0), "m12": (0, 1), "m13": (0, 2), "m23": (1, 2)}
    five = lambda c, n: F.round(c, 5).alias(n)
    return rows.select(
        "vec_id", five(F.col("cx"), "cx"), five(F.col("cw"), "cw"), *(five(F.col("m")[i][j], n) for n, (i, j) in cells.items()), *(five(c, n) for c, n in zip(back, ("bx", "by_", "bz", "bw"), strict=True))
    )


_LISTS = "with o as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_tax) q, list(l_tax order by l_linenumber, l_quantity, l_tax) t from lineitem group by l_orderkey having count(*) >= 2)"


def _lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax"))).alias("s")).where(F.size("s") >= 2)
    return rows.select("l_orderkey", F.col("s.l_quantity").alias("q"), F.col("s.l_tax").alias("t"))


@query(_LISTS + """
select l_orderkey, list_transform(range(len(q)), lambda i: q[(i + 1) % len(q) + 1]) turned, list_transform(range(len(q)), lambda i: (i - 1 + len(q)) % len(q)) back,
 list_transform(range(1, len(q)), lambda i: round((q[i] + q[i + 1]) / 2, 6)) centers, list_transform(range(len(q)), lambda i: l_orderkey * 8 + i) flat,
 list_transform(range(len(q)), lambda i: (l_orderkey * 8 + i) // 4 % 2) axis from o""")
def index_arrays(spark, sf_dir):
    """Elements taken by an index, its inverse, centres of edges, places in a flattened array and back."""
    every = F.sequence(F.lit(0), F.size("q") - 1)
    rows = _lists(spark, sf_dir).withColumn("i", F.transform(every, lambda i: F.pmod(i + 1, F.size("q"))))
    flat = F.transform(every, lambda i: H.flat_index(F.col("l_orderkey"), i, 8).cast("long"))
    return rows.select(
        "l_orderkey", H.apply_index(F.col("q"), F.col("i")).alias("turned"), F.transform(H.reverse_index(F.col("i")), lambda x: x.cast("long")).alias("back"),
        F.transform(H.edges_to_centers(F.col("q")), lambda x: F.round(x, 6)).alias("centers"), flat.alias("flat"), F.transform(flat, lambda p: H.axis_index(p, (9, 2, 4), 1)).alias("axis"),
    )


@query(_LISTS + """
select l_orderkey, q || t wide, list_transform(range(len(q)), lambda i: [q[i + 1], t[i + 1]]) deep, [t[1]] || q[:1] || t[2:] || q[2:] placed, list_transform(q[:2], lambda x: case when x <= 45 then x else -1e31 end) again from o""")
def stacked_arrays(spark, sf_dir):
    """Arrays beside and behind each other, placed by index, labelled as columns and bundled again."""
    rows = _lists(spark, sf_dir)
    # the first array's elements stand second and after the second array's
    n, m = F.size("t"), F.size("q")
    index = F.concat(F.array(F.lit(1)), F.transform(F.sequence(F.lit(1), m - 1), lambda k: n + k))
    rows = rows.select("l_orderkey", H.side_by_side(F.col("q"), F.col("t")).alias("wide"), H.in_depth(F.col("q"), F.col("t")).alias("deep"), B.placed(F.col("q"), F.col("t"), index).alias("placed"), "q")
    keep = ("l_orderkey", "wide", "deep", "placed")
    rows = H.labelled(rows, "q", ["first", "second"], keep, lambda x: R.replace_invalid(x, None, None, 45.0))
    out = H.bundled(rows, ["first", "second"], -1e31, "again")
    return out.select(*keep, "again")


@query("select event_type, round(avg(user_id), 6) rate from events group by event_type")
def poisson_rates(spark, sf_dir):
    return S.poisson_rate(_events(spark, sf_dir), "user_id", ("event_type",)).select("event_type", r6("rate").alias("rate"))


@query("""
with w as (select event_id, 300 + value u, 1 + value / 50 n, 2 + user_id / 10.0 b, (user_id * 2.4) clock from events),
a as (select *, b * (1e-12 / sqrt(4e-7 * pi() * 1.67e-27 * 1000000)) / sqrt(n) va from w)
select event_id, round(va, 6) alfven, round(u / va, 6) mach, round(u * b * b * pow(sin(radians(clock) / 2), 4) * 1e-15 / (4e-7 * pi()) * 1e6, 6) energy,
 round(sqrt(n * 1e-9 / (u / 3.1 * 1e6) / (3.1 * 1.6276e-27)) / 1000, 6) thermal, round(u * 5.0 / (b * 6371.0), 6) courant, round(n * u * 1e9 / 1e9, 6) through, round(1000 * n * u, 4) along from a""")
def wind_coupling(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    speed, n, b, clock = 300 + v, 1 + v / 50, 2 + u / 10.0, u * 2.4
    return _events(spark, sf_dir).select(
        "event_id", r6(P.alfven_speed_wind(b, n)).alias("alfven"), r6(P.alfven_mach(speed, b, n)).alias("mach"), r6(P.coupling(speed, b, clock) * 1e6).alias("energy"), r6(P.thermal_speed(n, speed)).alias("thermal"),
        r6(D.courant(speed, 5.0, b)).alias("courant"), r6(P.radial_flux(n, speed) / 1e9).alias("through"), F.round(P.number_flux(n, speed), 4).alias("along"),
    )


@query("""
with f as (select event_id, value / 10 jx, user_id / 5.0 jy, -2.0 jz, 3.0 bx, value / 50 as yy, -1.5 bz from events)
select event_id, round(1e6 * (jy * bz - jz * yy) * 1e-6, 6) fx, round(1e6 * (jz * bx - jx * bz) * 1e-6, 6) fy, round(1e6 * (jx * yy - jy * bx) * 1e-6, 6) fz, round(sqrt(jx * jx + jy * jy + jz * jz), 6) size, round(sqrt(bx * bx + yy * yy), 6) h from f""")
def currents_and_forces(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    j, b = (v / 10, u / 5.0, F.lit(-2.0)), (F.lit(3.0), v / 50, F.lit(-1.5))
    force = P.lorentz_force(j, b)
    return _events(spark, sf_dir).select("event_id", *(r6(1e6 * c).alias(n) for c, n in zip(force, ("fx", "fy", "fz"), strict=True)), r6(V.hypot(*j)).alias("size"), r6(P.horizontal_current((b[0], b[1]))).alias("h"))


@query("""
select event_id, round(value / 1, 6) n_h, round(user_id / 16.0, 6) n_o, round(value + user_id / 16.0, 6) n, round(100 * value / (value + user_id / 16.0), 6) share_h from events where value + user_id > 0""")
def fluid_densities(spark, sf_dir):
    rows = _events(spark, sf_dir).where("value + user_id > 0").select("event_id", F.col("value").alias("Hprho"), F.col("user_id").cast("double").alias("Oprho"))
    return P.densities(rows).select("event_id", r6("HpN").alias("n_h"), r6("OpN").alias("n_o"), r6("N").alias("n"), r6("HpFrac").alias("share_h"))


_TURNED = "select event_id, (3 + value / 100) * sin(user_id / 50.0 + 0.1) x, (3 + value / 100) * cos(user_id / 50.0 + 0.1) y, 3 + value / 100 r, user_id / 50.0 + 0.1 a from events"


@query(f"""
with p as ({_TURNED}), d as (select *, sqrt(1 + 3 * cos(a) * cos(a)) d from p)
select event_id, round(30400 * d / (r * r * r), 4) b, round(3 * cos(a) * sin(a) / d, 6) bx, round((2 * cos(a) * cos(a) - sin(a) * sin(a)) / d, 6) as by_, round(r / pow(sin(a), 2) * pow(sin(pi() / 4), 3), 5) line_x, round(r / pow(sin(a), 2) * pow(sin(pi() / 4), 2) * cos(pi() / 4), 5) line_y from d where sin(a) > 0.2""")
def dipole_field(spark, sf_dir):
    """Strength and direction of a dipole, and the point at a quarter of the field line through each place."""
    v, a = F.col("value"), F.col("user_id") / 50.0 + 0.1
    r = 3 + v / 100
    rows = _events(spark, sf_dir).where(F.sin(a) > 0.2).select("event_id", (r * F.sin(a)).alias("x"), (r * F.cos(a)).alias("y"))
    x, y = F.col("x"), F.col("y")
    bx, by = P.dipole_direction(x, y)
    point = F.get(P.field_line(x, y, 4), F.lit(1))
    return rows.select("event_id", F.round(P.dipole_strength(x, y), 4).alias("b"), r6(bx).alias("bx"), r6(by).alias("by_"), F.round(point["x"], 5).alias("line_x"), F.round(point["y"], 5).alias("line_y"))


@query("""
with e as (select event_id, 2 + value / 100 l, user_id / 20.0 kp, 70 + user_id f from events),
s as (select *, pow(10, -0.3145 * l + 3.9043) full_, 4.5e-2 * exp(0.17 * kp + 0.01 * f) oh from e), h as (select *, 0.618182 * oh * exp(-0.24 * kp - 0.011 * f) + 0.011 * oh heh from s)
select event_id, round(full_, 4) full_, round((full_ - 20) / full_ * (2 * 1879379699284659.0::double * 1.29762044 * pow(10, -0.3145 * 1.29762044 + 3.9043) / (1.5 * 86400.0)) * sin(pi() / 2 - acos(1 / sqrt(l))) / (l * l * l) / 1e12, 5) refill,
 round(1 / (1 + heh + oh), 6) hydrogen, round(heh / (1 + heh + oh), 6) helium, round(oh / (1 + heh + oh), 6) oxygen from h""")
def plasmasphere(spark, sf_dir):
    shell, kp = 2 + F.col("value") / 100, F.col("user_id") / 20.0
    h, he, o = P.composition(kp, 70 + F.col("user_id"))
    return _events(spark, sf_dir).select(
        "event_id", F.round(P.saturation_density(shell), 4).alias("full_"), F.round(P.refill_flux(F.lit(20.0), shell) / 1e12, 5).alias("refill"), r6(h).alias("hydrogen"), r6(he).alias("helium"), r6(o).alias("oxygen")
    )


_ORDER = ", ".join(map(str, E.VAMPOLA_ORDER))


@query(f"""
with e as (select event_id, 2.5 + value / 60 l, user_id / 20.0 kp, (value - 250) / 50 bz, 0.5 + user_id / 40.0 p, 6 + user_id % 13 lt from events),
v as (select *, least(greatest((l - 3) / 0.25, 0), 20) pos, [{_ORDER}]::double[] t from e), k as (select *, least(floor(pos), 19)::int k from v),
m as (select *, (11.4 + case when bz >= 0 then 0.013 else 0.140 end * bz) * pow(p, -1 / 6.6) * pow(2 / (1 + cos((12 - lt) * pi() / 12)), (0.58 - 0.01 * bz) * (1 + 0.01 * p)) r from k)
select event_id, round(t[k + 1] + (pos - k) * (t[k + 2] - t[k + 1]), 6) ord, round(log10(pow(10, 0.506 * kp - 9.325) * pow(l, 10)), 6) ba, round(log10(1.5e-6 * pow(l, 8.5)), 6) fc, round(log10(7.7e-6 * pow(l, 6)), 6) u, round(log10(1.9e-10 * pow(l, 11.7)), 6) s,
 round(r * cos((12 - lt) * pi() / 12), 5) x, round(r * sin((12 - lt) * pi() / 12), 5) y from m""")
def belt_models(spark, sf_dir):
    """Order of pitch-angle distributions, radial diffusion by four models, and the magnetopause at a local time."""
    shell, kp = 2.5 + F.col("value") / 60, F.col("user_id") / 20.0
    d = {n: rounded(F.log10(E.diffusion_coefficient(shell, kp, m)), 6).alias(n) for n, m in (("ba", "BA2000"), ("fc", "FC2006"), ("u", "U2008"), ("s", "S1997"))}
    x, y = E.magnetopause((F.col("value") - 250) / 50, 0.5 + F.col("user_id") / 40.0, 6 + F.col("user_id") % 13)
    return _events(spark, sf_dir).select("event_id", rounded(E.vampola_order(shell), 6).alias("ord"), *d.values(), rounded(x, 5).alias("x"), rounded(y, 5).alias("y"))


@query("""
with e as (select event_id, 1.75 + value / 80.37 r, (epoch_us(ts) % 86400000000) / 3600e6 h from events),
g as (select i, 1.75 + i * 4.75 / 19 low, 1.75 + (i + 1) * 4.75 / 19 high from (select unnest(range(20)) i)), c as (select i, i / 24.0 * 24 low, (i + 1) / 24.0 * 24 high from (select unnest(range(24)) i))
select event_id, g.i::bigint radius, c.i::bigint as hour, round(c.i / 24.0 * 2 * pi(), 6) angle from e left join g on r >= g.low and r < g.high and r <= 6.5 left join c on h >= c.low and h < c.high""")
def model_grids(spark, sf_dir):
    """The cell of the radius and local-time grids that each event is in."""
    hours = (T.utc_us(F.col("ts")) % T.DAY_US) / 3600e6
    rows = _events(spark, sf_dir).select("event_id", E.grid_place(1.75 + F.col("value") / 80.37, 1.75, 6.5, 20).alias("radius"), E.grid_place(hours, 0.0, 24.0, 25).alias("hour"))
    return rows.select("*", r6(F.col("hour") / 24.0 * (2 * math.pi)).alias("angle"))


@query("""
with e as (select event_id, epoch_us(ts) // 1000 * 1000 us from events)
select event_id, us as cdf, us as tt, us as pair, round(us / 86400e6, 9) as day from e""")
def time_scales_back(spark, sf_dir):
    """CDF milliseconds, TT2000 and pairs of seconds and picoseconds turned back into UTC, and days as plots count them.

    Times are cut to milliseconds, which CDF milliseconds hold exactly.
    """
    us = T.utc_us(F.col("ts"))
    rows = _events(spark, sf_dir).select("event_id", (us - us % 1000).alias("us"))
    rows = rows.select("event_id", T.cdf_ms(F.col("us")).alias("ms"), T.tt2000_ns(F.col("us")).alias("ns"), T.epoch16(F.col("us")).alias("p"))
    return rows.select("event_id", T.utc_us_of_cdf_ms(F.col("ms")).alias("cdf"), T.utc_us_of_tt2000(F.col("ns")).alias("tt"), T.utc_us_of_cdf_ms(T.epoch16_to_ms(F.col("p"))).alias("pair"), F.round(T.day_number(F.col("ms")), 9).alias("day"))


_SAID = "case when event_id % 10 = 0 then strftime(ts, '%Y-%m-%dT%H:59:60') when event_id % 10 = 1 then strftime(ts, '%Y-%m-%d %H:59:60.25') else strftime(ts, '%Y-%m-%dT%H:%M:%S') end"


@query("""
select event_id, case when event_id % 10 < 2 then strftime(ts, '%Y-%m-%dT%H:59:60') else strftime(ts, '%Y-%m-%dT%H:%M:%S') end iso,
 case when event_id % 10 = 0 then date_trunc('hour', ts) + interval '59 minutes 59 seconds' when event_id % 10 = 1 then date_trunc('hour', ts) + interval '59 minutes 59 seconds 250 milliseconds' else date_trunc('second', ts) end utc,
 case when event_id % 10 < 2 then 1000000 else 0 end::int offset_us from events""")
def leap_second_texts(spark, sf_dir):
    k = F.col("event_id") % 10
    said = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:59:60")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:59:60.25")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return _events(spark, sf_dir).select("event_id", T.leap_aware(said).alias("t")).select("event_id", "t.*")


@query("""
with f as (select event_id, 'run/' || event_type || '/file_' || case when event_id % 5 = 0 then '99991399' else strftime(ts, '%Y%m%d') end || '_v' || user_id || '.cdf' path, event_type, ts from events)
select event_id, case when event_id % 5 = 0 then null else ts::date end as day, event_type as second, 'run/' || regexp_extract(path, '[^/]*$') ends, event_type || '/' || regexp_extract(path, '[^/]*$') rest from f""")
def names_of_files(spark, sf_dir):
    """The date in a file's name and slices of its path."""
    name = F.concat(F.lit("run/"), "event_type", F.lit("/file_"), F.when(F.col("event_id") % 5 == 0, "99991399").otherwise(F.date_format("ts", "yyyyMMdd")), F.lit("_v"), F.col("user_id").cast("string"), F.lit(".cdf"))
    rows = _events(spark, sf_dir).select("event_id", name.alias("path"))
    p = F.col("path")
    return rows.select("event_id", T.date_in_name(p).alias("day"), X.path_slice(p, 1).alias("second"), X.path_slice(p, 0, step=2).alias("ends"), X.path_slice(p, 1, 3).alias("rest"))


@query("""
select event_id, user_id * 10 iteration, user_id % 24 * 3600 + 1830 runtime, date_trunc('second', ts) as time from events""")
def model_file_times(spark, sf_dir):
    u = F.col("user_id")
    name = F.concat(F.lit("out/y=0_n"), F.lpad((u * 10).cast("string"), 8, "0"), F.lit("_t"), F.lpad((u % 24).cast("string"), 4, "0"), F.lit("3030_e"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".out"))
    return _events(spark, sf_dir).select("event_id", X.file_times(name).alias("t")).select("event_id", F.col("t.iteration").alias("iteration"), F.col("t.runtime").cast("long").alias("runtime"), "t.time")


@query("select event_id, round(value / 1000, 9) energy, round(user_id * 1000.0, 6) flux from events")
def energy_units(spark, sf_dir):
    energy, flux = X.per_energy(F.col("value"), F.col("user_id").cast("double"), "keV", "MeV")
    return _events(spark, sf_dir).select("event_id", F.round(energy, 9).alias("energy"), r6(flux).alias("flux"))


@query("select ts from (select ts from events where event_type = 'error' union select ts from events where user_id < 5) ")
def restored_epochs(spark, sf_dir):
    events = _events(spark, sf_dir)
    return M.all_epochs(events.where("event_type = 'error'"), events.where("user_id < 5"), "ts")


@query("select min(ts) as first, max(ts) as last from events")
def covered_span(spark, sf_dir):
    return M.span_of(_events(spark, sf_dir), "ts")


@query(f"""
with e as (select event_id, epoch_us(ts) / 86400e6 + 2440587.5 jd from events), t as (select *, (jd - 2451545.0) / 36525 t from e)
select event_id, round(cos((-19089.45159 + (8640184.812866 + (0.093104 - 6.2e-6 * t) * t) * t + 86400 * (jd % 1)) * pi() / 43200), 4) c, round(sin((-19089.45159 + (8640184.812866 + (0.093104 - 6.2e-6 * t) * t) * t + 86400 * (jd % 1)) * pi() / 43200), 4) s from t""")
def sidereal_times(spark, sf_dir):
    a = frames.gmst(T.utc_us(F.col("ts")))
    return _events(spark, sf_dir).select("event_id", F.round(F.cos(a), 4).alias("c"), F.round(F.sin(a), 4).alias("s"))


@query("""
select event_id, round(1 + value / 100, 5) x, round(user_id / 10.0 - 7, 5) y, round(-2.5, 5) z, round(sqrt(pow(1 + value / 100, 2) + pow(user_id / 10.0 - 7, 2) + 6.25), 5) far from events""")
def frames_and_back(spark, sf_dir):
    """Positions from GEO through GSM, SM, GSE and ECI2000 back to GEO; their distance holds in each frame."""
    rows = _events(spark, sf_dir).select("event_id", "ts", (1 + F.col("value") / 100).alias("x"), (F.col("user_id") / 10.0 - 7).alias("y"), F.lit(-2.5).alias("z"))
    axes = ("x", "y", "z")
    for a, b in (("GEO", "GSM"), ("GSM", "SM"), ("SM", "GSE"), ("GSE", "J2000")):
        rows = frames.convert(rows, "ts", axes, a, b)
    rows = rows.withColumn("far", V.hypot(*map(F.col, axes)))
    rows = frames.convert(rows, "ts", axes, "J2000", "GEO")
    return rows.select("event_id", *(F.round(c, 5).alias(c) for c in (*axes, "far")))


@query("select c_custkey, round(7000.0 + c_custkey % 900, 4) radius, (c_custkey % 171 - 85)::double lat, (c_custkey % 360 - 179)::double lon from customer")
def radial_positions(spark, sf_dir):
    """Radius, geodetic latitude and longitude to positions and back."""
    k = F.col("c_custkey")
    x, y, z = G.radial_to_geocentric((7000 + k % 900).cast("double"), (k % 171 - 85).cast("double"), (k % 360 - 179).cast("double"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    rows = G.geocentric_to_radial(rows, "x", "y", "z")
    lon = F.when(F.round("lon", 5) == -180, 180.0).otherwise(F.round("lon", 5))
    return rows.select("c_custkey", F.round("radius", 4).alias("radius"), (F.round("lat", 5) + 0.0).alias("lat"), (lon + 0.0).alias("lon"))


@query("""
with g as (select c_custkey % 40 i, c_custkey // 40 % 30 j, avg(c_acctbal) v from customer group by 1, 2), p as (select event_id, (value / 500) * 38.9 x, user_id % 28 + 0.25 y from events)
select event_id, round(a.v * (1 - x + floor(x)) * 0.75 + b.v * (x - floor(x)) * 0.75 + c.v * (1 - x + floor(x)) * 0.25 + d.v * (x - floor(x)) * 0.25, 4) as value from p
join g a on a.i = floor(x) and a.j = floor(y) join g b on b.i = floor(x) + 1 and b.j = floor(y) join g c on c.i = floor(x) and c.j = floor(y) + 1 join g d on d.i = floor(x) + 1 and d.j = floor(y) + 1 where x between 0 and 39""")
def grid_interpolation(spark, sf_dir):
    """Bilinear values at points from a grid of mean balances."""
    k = F.col("c_custkey")
    grid = table(spark, sf_dir, "customer").groupBy((k % 40).cast("int").alias("i"), (F.floor(k / 40) % 30).cast("int").alias("j")).agg(F.avg("c_acctbal").alias("value"))
    points = _events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("value") / 500 * 38.9).alias("x"), (F.col("user_id") % 28 + 0.25).alias("y")).where("x between 0 and 39")
    return I.interpolate_grid(points, grid, 0.0, 1.0, 40, 0.0, 1.0, 30).select(F.col("id").alias("event_id"), F.round("value", 4).alias("value"))


@query("""
with p as (select event_id, value / 500 * 63.9 x, (user_id * 7 % 640) / 10.0 y from events)
select event_id, (case when x < 32 and y < 32 then 1000 + floor(x / 8) * 100 + floor(y / 8) else 2000 + floor(x / 16) * 100 + floor(y / 16) end)::bigint leaf from p where x >= 0 and x < 64 and y < 64""")
def cells_of_tree(spark, sf_dir):
    """Points in the leaves of a tree: small ones in one quarter of the plane, larger ones elsewhere."""
    small = spark.range(16).select((1000 + F.floor(F.col("id") / 4) * 100 + F.col("id") % 4).alias("leaf"), (F.floor(F.col("id") / 4) * 8.0).alias("x0"), (F.col("id") % 4 * 8.0).alias("y0"), F.lit(8.0).alias("w"))
    large = spark.range(16).select((2000 + F.floor(F.col("id") / 4) * 100 + F.col("id") % 4).alias("leaf"), (F.floor(F.col("id") / 4) * 16.0).alias("x0"), (F.col("id") % 4 * 16.0).alias("y0"), F.lit(16.0).alias("w"))
    leaves = small.union(large.where("x0 >= 32 or y0 >= 32")).select("leaf", "x0", (F.col("x0") + F.col("w")).alias("x1"), "y0", (F.col("y0") + F.col("w")).alias("y1"))
    points = _events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("value") / 500 * 63.9).alias("x"), (F.col("user_id") * 7 % 640 / 10.0).alias("y"))
    return I.leaf_of(points, leaves, 16.0).select(F.col("id").alias("event_id"), F.col("leaf").cast("long").alias("leaf"))


_GRID = "select event_id, event_id // 1000 blk, 2 + (event_id // 50) % 20 * 0.25 l, (event_id % 50) * 2 * pi() / 50 phi, value pot from events"


def _slope(c: str, along: str, across: str, step: str) -> str:
    w = f"over (partition by blk, {across} order by {along})"
    return f"case when lag({along}) {w} is null then -3 * ({c}) + 4 * lead({c}, 1) {w} - lead({c}, 2) {w} when lead({along}) {w} is null then 3 * ({c}) - 4 * lag({c}, 1) {w} + lag({c}, 2) {w} else lead({c}, 1) {w} - lag({c}, 1) {w} end / (2 * {step})"


@query(f"""with g as ({_GRID}), d as (select event_id, {_slope('pot * 1e6 / 6371000.0', 'l', 'phi', '0.25')} er, {_slope('pot * 1e6 / 6371000.0 / l', 'phi', 'l', '(2 * pi() / 50)')} ephi from g)
select event_id, round(er, 6) er, round(ephi, 6) ephi, round(sqrt(er * er + ephi * ephi), 6) e from d""")
def equatorial_field(spark, sf_dir):
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", F.floor(i / 1000).alias("blk"), (2 + F.floor(i / 50) % 20 * 0.25).alias("l"), ((i % 50) * (2 * math.pi / 50)).alias("phi"), F.col("value").alias("pot"))
    return D.potential_field(rows, "pot", "l", "phi", 0.25, 2 * math.pi / 50, ("blk",)).select("event_id", r6("er").alias("er"), r6("ephi").alias("ephi"), r6("e").alias("e"))


@query("select event_id, round(value + user_id, 6) n, round(2 * value, 6) e, round(3.0 * user_id, 6) d, round(value, 6) mhd, round(sqrt(pow(value + user_id, 2) + pow(2 * value, 2)), 6) h from events")
def station_fields(spark, sf_dir):
    """Older station columns summed into totals and renamed; the horizontal part of the total."""
    v, u = F.col("value"), F.col("user_id").cast("double")
    rows = _events(spark, sf_dir).select("event_id", v.alias("gm_dBn"), u.alias("ie_JpBn"), v.alias("gm_dBe"), v.alias("ie_JpBe"), (2 * u).alias("gm_dBd"), u.alias("ie_JhdBd"))
    rows = D.station_totals(rows)
    return rows.select("event_id", r6("dBn").alias("n"), r6("dBe").alias("e"), r6("dBd").alias("d"), r6("dBnMhd").alias("mhd"), r6(P.horizontal_current((F.col("dBn"), F.col("dBe")))).alias("h"))


@query("""
with e as (select event_type, value, user_id from events)
select 'value' as variable, event_type, count(*)::bigint n, round(avg(value), 6) mean from e group by event_type union all select 'user', event_type, count(*)::bigint, round(avg(user_id::double), 6) from e group by event_type""")
def variables_side_by_side(spark, sf_dir):
    rows = _events(spark, sf_dir)
    mean = lambda c: rows.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg(F.col(c).cast("double"))).alias("mean"))
    return M.side_by_side({"value": mean("value"), "user": mean("user_id")})


@query("select event_id, round(degrees(value / 100), 6) lat, round(degrees(user_id / 50.0), 6) lon from events")
def positions_in_degrees(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", (F.col("value") / 100).alias("Latitude"), (F.col("user_id") / 50.0).alias("Longitude"))
    return V.in_degrees(rows, {"Latitude": "lat", "Longitude": "lon", "Height": "none"}).select("event_id", r6("lat").alias("lat"), r6("lon").alias("lon"))


_STEPS = """
with recursive p as (select user_id run, 3 + 0.25 * k l, k, 1 + user_id % 7 + k * k / 10.0 f from (select distinct user_id from events), (select unnest(range(13)) k))"""


@query(_STEPS + " select run, round(l, 4) l, round(f, 6) psd from p where k in (0, 12)")
def diffusion_ends(spark, sf_dir):
    """Radial diffusion of a profile for each user: the ends of the profiles stay."""
    users = _events(spark, sf_dir).select("user_id").distinct()
    k = F.col("k")
    runs = users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12)))).select(F.col("user_id").alias("run"), (3 + 0.25 * k).alias("l"), (1 + F.col("user_id") % 7 + k * k / 10.0).alias("psd"))
    kp = users.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(F.col("user_id").alias("run"), "step", (F.col("user_id") % 9).cast("double").alias("kp"))
    out = I.radial_diffusion(runs, kp, 0.05)
    return out.where("step = 5 and (l = 3 or l = 6)").select("run", F.round("l", 4).alias("l"), r6("psd").alias("psd"))


@query("select user_id as run, (epoch_us(min(ts)) % 5)::int as member, round(avg(value), 6) psd from events group by user_id")
def assimilation_of_nothing(spark, sf_dir):
    """States of runs without observations stay as they are."""
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("run")).agg(F.pmod(F.min(T.utc_us(F.col("ts"))), F.lit(5)).cast("int").alias("member"), F.avg("value").alias("psd"))
    observed = rows.select("run", F.lit(4.0).alias("l"), "psd", F.lit(0.1).alias("spread")).limit(0)
    out = I.assimilate(rows.select("run", "member", F.lit(4.0).alias("l"), "psd"), observed)
    return out.select("run", "member", r6("psd").alias("psd"))


@query("""
with s as (select c_custkey seed, 1 + c_custkey % 40 * 0.1 x0, 1 + c_custkey % 30 * 0.1 y0 from customer), t as (select *, unnest(range(21)) step from s)
select seed, step::int step, round(x0 + step * 0.08 * 0.5, 5)::double x, round(y0 + step * 0.06 * 0.5, 5)::double y from t""")
def straight_streamlines(spark, sf_dir):
    """Lines of an even field from each customer's seed."""
    import numpy as np

    k = F.col("c_custkey")
    seeds = table(spark, sf_dir, "customer").select(k.alias("seed"), (1 + k % 40 * 0.1).alias("x"), (1 + k % 30 * 0.1).alias("y"))
    grid = np.arange(0, 20.5, 0.5)
    shape = (len(grid), len(grid))
    out = I.streamlines(seeds, grid, grid, np.full(shape, 4.0), np.full(shape, 3.0), steps=20, ds=0.1)
    return out.select("seed", "step", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""
with s as (select event_type, min(ts) lo, epoch_us(max(ts)) - epoch_us(min(ts)) wide, count(*) n from events group by event_type), i as (select event_type, lo, wide, unnest(range(n)) i from s),
n as (select event_type, lo, wide, i id, (i % {S.PRIME} * 48271 + 11 * 69621 + 1) % {S.PRIME} x from i), a as (select *, (x * x + x * 7 + 14) % {S.PRIME} y from n),
b as (select *, (y * y + y * 11 + id) % {S.PRIME} z from a), c as (select *, ((z * z + z * 13 + 5) % {S.PRIME}) / {S.PRIME}.0::double u from b)
select event_type, id::bigint id, make_timestamp((epoch_us(lo) + floor(u * wide)::bigint)::bigint) as ts from c""")
def random_epochs(spark, sf_dir):
    """As many random times over the span of each kind of event as it has events."""
    spans = _events(spark, sf_dir).groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return H.random_times_between(spans, "a", "b", "n", 11).select("event_type", "id", "ts")


@query("""
with s as (select user_id run, avg(value) b, min(value) o from events group by user_id), g as (select *, unnest([3, 4, 5]) l from s), m as (select *, unnest(range(5)) member from g)
select run, member::int as member, l::double l, round(b + l / 4.0 * (o - b), 5) psd from m""")
def ensemble_analysis(spark, sf_dir):
    """An exact observation at one of three places: all members of an ensemble that varies along a line meet in it."""
    runs = _events(spark, sf_dir).groupBy(F.col("user_id").alias("run")).agg(F.avg("value").alias("b"), F.min("value").alias("o"))
    every = runs.withColumn("l", F.explode(F.array(*map(F.lit, (3.0, 4.0, 5.0))))).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(4))))
    states = every.select("run", "member", "l", (F.col("b") + F.col("member") * F.col("l")).alias("psd"))
    out = I.assimilate(states, runs.select("run", F.lit(4.0).alias("l"), F.col("o").alias("psd"), F.lit(0.0).alias("spread")))
    return out.select("run", "member", "l", F.round("psd", 5).alias("psd"))


@query("""
with k as (select user_id run, user_id % 3 kp from (select distinct user_id from events)), l as (select *, unnest(range(1, 12)) i from k), p as (select *, 3 + 0.25 * i l, pow(10, 0.506 * kp - 9.325) c from l),
h as (select *, c * pow(l + 0.125, 8) * (pow((l + 0.25) / (l + 0.125), 10) + pow(l / (l + 0.125), 10)) / 2 hi, c * pow(l - 0.125, 8) * (pow((l - 0.25) / (l - 0.125), 10) + pow(l / (l - 0.125), 10)) / 2 lo from p)
select run, i::int i, round(l * l * (hi - lo) * 0.25 / 0.0625 * 1e-6, 9) growth from h""")
def diffusion_growth(spark, sf_dir):
    """How fast a profile that rises evenly with L grows inside, from one very short step."""
    users = _events(spark, sf_dir).select("user_id").distinct()
    k = F.col("k")
    runs = users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12)))).select(F.col("user_id").alias("run"), (3 + 0.25 * k).alias("l"), (0.25 * k).alias("psd"))
    kp = users.select(F.col("user_id").alias("run"), F.lit(0).alias("step"), (F.col("user_id") % 3).cast("double").alias("kp"))
    out = I.radial_diffusion(runs, kp, 1e-6).where("l > 3 and l < 6")
    i = ((F.col("l") - 3) * 4).cast("int")
    return out.select("run", i.alias("i"), F.round(F.col("psd") - 0.25 * i, 9).alias("growth"))


@query("""
with f as (select event_id, value / 50 bx, user_id / 30.0 as yy, -1.5 bz, value / 10 jx, user_id / 5.0 jy, -2.0 jz, 400 + value ux, user_id - 75.0 uy, 10.0 uz, 1 + user_id / 20.0 rho, 0.1 + value / 100 p from events),
g as (select *, sqrt(bx * bx + yy * yy + bz * bz) b, sqrt(ux * ux + uy * uy + uz * uz) u, (ux * bx + uy * yy + uz * bz) / sqrt(bx * bx + yy * yy + bz * bz) along from f)
select event_id, round(b, 6) b, round(p * 400 * pi() / (b * b), 6) beta, round(sqrt(jx * jx + jy * jy + jz * jz), 6) j,
 round(1e3 * sqrt((jy * bz - jz * yy) ** 2 + (jz * bx - jx * bz) ** 2 + (jx * yy - jy * bx) ** 2) * 1e-6, 6) jb, round(u, 6) u,
 round((uz * yy - uy * bz) / 1000, 6) ex, round((ux * bz - uz * bx) / 1000, 6) ey, round((uy * bx - ux * yy) / 1000, 6) ez, round(along, 6) upar,
 round(sqrt(greatest(u * u - along * along, 0)), 4) uperp, round(1e6 * b * 1e-12 / sqrt(rho * 4e-7 * pi() * 1.6726e-27 * 1e6), 4) alfven, round(p * 6241.50935 / rho, 5) t from g""")
def all_derived(spark, sf_dir):
    """All quantities that field, current, flow, density and pressure give, in one projection."""
    v, w = F.col("value"), F.col("user_id")
    given = {"bx": v / 50, "by": w / 30.0, "bz": F.lit(-1.5), "jx": v / 10, "jy": w / 5.0, "jz": F.lit(-2.0), "ux": 400 + v, "uy": w - 75.0, "uz": F.lit(10.0), "rho": 1 + w / 20.0, "p": 0.1 + v / 100}
    rows = P.derived(_events(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in given.items())), alfven_scale=1e6)
    scaled = {"jb": (1e3, 6), "uperp": (1, 4), "alfven": (1, 4), "t": (1, 5)}
    names = ("b", "beta", "j", "jb", "u", "ex", "ey", "ez", "upar", "uperp", "alfven", "t")
    return rows.select("event_id", *(rounded(scaled.get(n, (1, 6))[0] * F.col(n), scaled.get(n, (1, 6))[1]).alias(n) for n in names))
