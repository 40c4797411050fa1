"""Projections, rules, arrays, vectors and model expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions import empirical as E
from tideframe.functions import geodesy as G
from tideframe.functions import plasma as P
from tideframe.functions import vectors as V
from tideframe.operators import rules as R
from tideframe.operators import shape as H
from tideframe.operators.series import row_numbers
from tideframe.plans.registry import Registry, r6, table

query = Registry()


@query("select event_id, round(case when abs(value - 99.99) <= 1e-8 + 1e-5 * 99.99 or value < 5 or value > 450 then null else value end, 6) as value from events")
def quality_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(R.replace_invalid(F.col("value"), 99.99, 5, 450)).alias("value"))


@query("""select case when value < 5 then 'below' else 'above' end as rule, count(*)::bigint n, round(min(value), 6) least, round(max(value), 6) most from events
where not abs(value - 99.99) <= 1e-8 + 1e-5 * 99.99 and (value < 5 or value > 450) group by 1""")
def valid_range(spark, sf_dir):
    out = R.out_of_range(table(spark, sf_dir, "events"), "value", 99.99, 5, 450)
    return out.select("rule", "n", r6("least").alias("least"), r6("most").alias("most"))


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def unique_columns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("select round(min(l_extendedprice), 6) min_l_extendedprice, round(max(l_extendedprice), 6) max_l_extendedprice, round(min(l_tax), 6) min_l_tax, round(max(l_tax), 6) max_l_tax from lineitem")
def pmm(spark, sf_dir):
    out = H.finite_range(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_tax")
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("select date_trunc('day', o_orderdate)::date as day, count(*)::bigint n, round(sum(o_totalprice), 2) total from orders group by 1")
def daily_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) length from embeddings")
def array_hypot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.array_hypot(F.col("embedding")), 5).alias("length"))


_XYZ = "embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, embedding[4]::double w"


@query(f"""select vec_id, round(sqrt(x * x + y * y + z * z), 5) r, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) lat, round(degrees(atan2(y, x)), 4) lon from (select vec_id, {_XYZ} from embeddings)""")
def car2sph(spark, sf_dir):
    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", V.car2sph(*e).alias("s")).select("vec_id", F.round("s.r", 5).alias("r"), F.round("s.lat", 4).alias("lat"), F.round("s.lon", 4).alias("lon"))


@query(f"""
with q as (select vec_id, x / n x, y / n y, z / n z, w / n w from (select *, sqrt(x * x + y * y + z * z + w * w) n from (select vec_id, {_XYZ} from embeddings)))
select vec_id, round(1 - 2 * (y * y + z * z), 5) vx, round(2 * (x * y + z * w), 5) vy, round(2 * (x * z - y * w), 5) vz, round(-x * x - y * y - z * z + w * w, 5) ww from q""")
def quat_rotate(spark, sf_dir):
    """The x axis rotated by the first four components as a quaternion, and the scalar part of its square."""
    q = tuple(F.col("embedding")[k].cast("double") for k in range(4))
    v = V.quat_rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    square = V.quat_multiply(V.quat_normalize(q), V.quat_normalize(q))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(c, 5).alias(n) for c, n in zip((*v, square[3]), ("vx", "vy", "vz", "ww"), strict=True)))


@query("select c_custkey, round((c_custkey % 24 - 12) * pi() / 12, 6) rad, (c_custkey % 24)::double mlt from customer")
def local_time_angle(spark, sf_dir):
    mlt = (F.col("c_custkey") % 24).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", r6(V.mlt2rad(mlt)).alias("rad"), r6(V.rad2mlt(V.mlt2rad(mlt))).alias("mlt"))


@query("select c_custkey, (c_custkey % 171 - 85)::double lat, (c_custkey % 360 - 180)::double lon, (c_custkey % 3000)::double alt from customer")
def geodetic_round_trip(spark, sf_dir):
    """Geodetic to geocentric and back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", *((F.col("c_custkey") % m - s).cast("double").alias(n) for n, m, s in (("lat", 171, 85), ("lon", 360, 180), ("alt", 3000, 0))))
    x, y, z = G.geodetic_to_geocentric(F.col("lat"), F.col("lon"), F.col("alt"))
    rows = rows.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    rows = G.geocentric_to_geodetic(rows, "x", "y", "z")
    lon = F.when(F.round("lon", 5) == 180, -180.0).otherwise(F.round("lon", 5))
    return rows.select("c_custkey", (F.round("lat", 5) + 0.0).alias("lat"), (lon + 0.0).alias("lon"), (F.round("alt", 4) + 0.0).alias("alt"))


@query("""
with w as (select event_id, 300 + value u, 1 + value / 50 n, (value - 250) / 25 bz, 2.0 as yy from events)
select event_id, round(u * u * n * 1.67621e-6, 6) pram, round(degrees(atan2(yy, bz)), 5) clock,
 round((11.4 + case when bz >= 0 then 0.013 else 0.140 end * bz) * pow(1 + n / 10, -1 / 6.6), 6) r0, round(pow(u / 258.0, 3.113) * 1.16045221e4, 2) texp,
 round(-value / 10 - 7.26 * sqrt(n) + 11.0, 6) dststar, round(6.07e-5 * value * value / 100 - 0.0436 * value / 10 + 9.37, 6) lmax from w join events using (event_id)""")
def solar_wind(spark, sf_dir):
    v = F.col("value")
    u, n, bz, by = 300 + v, 1 + v / 50, (v - 250) / 25, F.lit(2.0)
    return table(spark, sf_dir, "events").select(
        "event_id", r6(P.ram_pressure(u, n)).alias("pram"), F.round(P.clock_angle(by, bz), 5).alias("clock"), r6(E.magnetopause_shape(bz, 1 + n / 10)[0]).alias("r0"),
        F.round(E.expected_temperature(u), 2).alias("texp"), r6(E.dst_star(-v / 10, n)).alias("dststar"), r6(E.l_max(-v / 10)).alias("lmax"),
    )


@query("""
with f as (select event_id, value / 10 ux, 20.0 uy, -10.0 uz, 5.0 bx, value / 100 as yy, -3.0 bz, value / 200 p, 1 + value / 40 n from events),
m as (select *, sqrt(bx * bx + yy * yy + bz * bz) b from f)
select event_id, round(abs(0) + sqrt(pow(uy * bz - uz * yy, 2) + pow(uz * bx - ux * bz, 2) + pow(ux * yy - uy * bx, 2)) / b, 6) uperp, round((ux * bx + uy * yy + uz * bz) / b, 6) upar,
 round(-(uy * bz - uz * yy) / 1000, 6) ex, round(400 * pi() * p / (b * b), 6) beta, round(6241.50935 * p / n, 4) temp, round(degrees(asin(bz / b)), 5) incl from m""")
def plasma_frame(spark, sf_dir):
    v = F.col("value")
    u, b = (v / 10, F.lit(20.0), F.lit(-10.0)), (F.lit(5.0), v / 100, F.lit(-3.0))
    size = V.hypot(*b)
    return table(spark, sf_dir, "events").select(
        "event_id", r6(P.speed_across(u, b)).alias("uperp"), r6(P.speed_along(u, b)).alias("upar"), r6(P.electric_field(u, b)[0]).alias("ex"), r6(P.plasma_beta(v / 200, size)).alias("beta"),
        F.round(P.temperature(v / 200, 1 + v / 40), 4).alias("temp"), F.round(P.inclination(b[2], size), 5).alias("incl"),
    )


@query("""
select p_partkey, lower(p_brand) as brand, row_number() over (order by regexp_extract(lower(p_brand), '^[^0-9]*'), coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) as int), -1), p_partkey)::int as place from part""")
def human_sort(spark, sf_dir):
    """Places in natural order; rows of one key are cut into buckets of a million keys of the table."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("brand"), H.natural_key(F.col("p_brand")).alias("key"))
    bucket = F.struct(F.col("key").alias("key"), F.floor(F.col("p_partkey") / 1_000_000).alias("part"))
    return row_numbers(rows, ["key", "p_partkey"], bucket).select("p_partkey", "brand", (F.col("row") + 1).cast("int").alias("place"))


_SPAN = "s as (select event_type, 1 + min(value) a, 1 + max(value) b from events group by event_type)"


@query(f"""with {_SPAN} select event_type, i::bigint id, round(a + i / 40.0 * (b - a), 6) lin, round(pow(10.0::double, log10(a) + i / 40.0 * (log10(b) - log10(a))), 6) log, round(a * pow(1.1, i), 6) geo from s, (select unnest(range(41)) i)""")
def sequences(spark, sf_dir):
    """Even, logarithmic and geometric sequences over the values of each kind of event."""
    spans = table(spark, sf_dir, "events").groupBy("event_type").agg((1 + F.min("value")).alias("a"), (1 + F.max("value")).alias("b"))
    rows = H.spaced(spans, F.col("a"), F.col("b"), 41, out="lin").withColumn("log", F.lit(0.0))
    log = H.spaced(spans, F.col("a"), F.col("b"), 41, how="log", out="log").select("event_type", "id", "log")
    rows = rows.drop("log").join(log, ["event_type", "id"]).withColumn("geo", F.col("a") * F.pow(F.lit(1.1), F.col("id").cast("double")))
    return rows.select("event_type", "id", r6("lin").alias("lin"), r6("log").alias("log"), r6("geo").alias("geo"))


@query("""select event_id, round(3.2e7 * exp(-0.96 * ln(0.1 + value) - (0.1 + value) / 15), 3) fluence from events""")
def proton_spectrum(spark, sf_dir):
    """Fluence of solar protons at the energy that each event's value stands for."""
    return table(spark, sf_dir, "events").select("event_id", F.round(E.proton_fluence(0.1 + F.col("value")), 3).alias("fluence"))


@query("""
with o as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_tax) q, list(l_tax order by l_linenumber, l_quantity, l_tax) t from lineitem group by l_orderkey having count(*) >= 2)
select l_orderkey, list_transform(range(len(q) * 2), lambda i: round(case when i % 2 = 0 then q[i // 2 + 1] else t[i // 2 + 1] end, 6)) woven,
 list_transform(range(len(q) + 1), lambda i: round(case when i = 0 then 2 * q[1] - (q[1] + q[2]) / 2 when i = len(q) then 2 * q[len(q)] - (q[len(q)] + q[len(q) - 1]) / 2 else (q[i] + q[i + 1]) / 2 end, 6)) edges from o""")
def arrays_reshaped(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax"))).alias("s")).where(F.size("s") >= 2)
    six = lambda a: F.transform(a, lambda x: F.round(x, 6))
    return rows.select("l_orderkey", six(H.interweave(F.col("s.l_quantity"), F.col("s.l_tax"))).alias("woven"), six(H.centers_to_edges(F.col("s.l_quantity"))).alias("edges"))


@query("select l_shipmode_first, first from (select l_returnflag l_shipmode_first, min(l_orderkey)::bigint first from lineitem group by 1)")
def first_seen(spark, sf_dir):
    return H.first_seen(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey").withColumnRenamed("l_returnflag", "l_shipmode_first")


@query("""
with c as (select s_suppkey, s_nationkey, s_acctbal from supplier)
select n_name, r_name, count(*)::bigint n, round(sum(s_acctbal), 2) total from c join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def nested_flatten(spark, sf_dir):
    """Tables nested into structs, flattened, unflattened and flattened again."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = rows.select(F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"), F.struct(F.col("s_acctbal").alias("balance")).alias("supplier"))
    flat = H.flatten(H.unflatten(H.flatten(nested)))
    return flat.groupBy(F.col("`nation<--name`").alias("n_name"), F.col("`nation<--region<--name`").alias("r_name")).agg(F.count("*").alias("n"), F.round(F.sum("`supplier<--balance`"), 2).alias("total"))
