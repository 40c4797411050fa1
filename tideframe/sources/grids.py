"""Readers of gridded model output: binary blocks, multi-frame text grids, array rows and blocks of index values.

Binary files are read whole, one file a row, and cut into batches of one variable; text grids are read by numbered lines,
so that one frame is bounded by its file.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.operators.series import carried, row_numbers
from tideframe.sources.text import PARTS, _number, _time, lines, numbered, tokens

_BLOCK = "path string, time timestamp_ntz, version double, variable string, i int, j int, k int, value double"


#: Lines of a file that are numbered and summed at a time.
PIECE = 100_000


def records(data: bytes) -> tuple[str, list[memoryview]]:
    """Byte order and the records of a Fortran sequential file: each stands between two copies of its length."""
    for order in "<>":
        view, at, out = memoryview(data), 0, []
        while at + 8 <= len(view):
            n = int(np.frombuffer(view[at : at + 4], f"{order}i4")[0])
            if n < 0 or at + 8 + n > len(view) or view[at : at + 4] != view[at + 4 + n : at + 8 + n]:
                break
            out.append(view[at + 4 : at + 4 + n])
            at += 8 + n
        if at == len(view) and out:
            return order, out
    raise ValueError("not a file of length-framed records")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            order, parts = records(content.as_buffer())
            real = f"{order}f{8 if len(parts[0]) > 4 else 4}"
            version = float(np.frombuffer(parts[0], real)[0])
            shape = tuple(int(n) for n in np.frombuffer(parts[1], f"{order}i4"))
            count = int(np.frombuffer(parts[2], f"{order}i4")[0])
            names = [bytes(p).decode().replace("[", "").replace("]", "").strip() for p in parts[3 : 3 + count]]
            *whole, milli = (int(x) for x in np.frombuffer(parts[3 + count], f"{order}i4"))
            time = dt.datetime(*whole) + dt.timedelta(milliseconds=milli)
            k, j, i = (a.ravel() for a in np.indices(shape[::-1], np.int32))
            for name, part in zip(names, parts[4 + count :], strict=True):
                value = np.frombuffer(part, real).astype(np.float64)
                n = len(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array([time] * n, pa.timestamp("us")), pa.array(np.full(n, version)), pa.array([name] * n), pa.array(i), pa.array(j), pa.array(k), pa.array(value)],
                    ["path", "time", "version", "variable", "i", "j", "k", "value"],
                )


def read_binary_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, time, version, variable, i, j, k, value) of binary files of one longitude, latitude, altitude block each.

    Byte order and precision are told by the record lengths; the first index runs fastest.
    """
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_blocks, _BLOCK)


def read_text_frames(spark: SparkSession, paths: str | list[str], variables: list[str] | None = None) -> DataFrame:
    """(path, frame, title, iteration, run_time, point, values by name) of text grids that hold one or more frames.

    A frame is a title, a line ``iteration time dimensions parameters variables``, the grid's sizes, the parameters if
    any, the names, and one line for each point. With ``variables`` these become columns in place of the map.
    """
    head = r"^\s*[+-]?\d+\s+[-+.\dEeDd]+\s+[+-]?\d+\s+\d+\s+\d+\s*$"
    w = Window.partitionBy("path").orderBy("n")
    rows = numbered(spark, paths).withColumn("t", tokens(F.col("value")))
    previous = F.lag("value").over(w)
    rows = rows.withColumn("start", (F.col("value").rlike(head) & ~F.coalesce(previous, F.lit("")).rlike(r"^[\s\d.+\-EeDd]*$")).cast("int"))
    rows = rows.withColumn("title", F.when(F.col("start") == 1, F.trim(previous))).withColumn("frame", F.sum("start").over(w) - 1)
    rows = rows.where("frame >= 0").withColumn("line", F.row_number().over(Window.partitionBy("path", "frame").orderBy("n")) - 1)
    line = lambda k: F.max(F.when(F.col("line") == k, F.col("t")))
    heads = rows.groupBy("path", "frame").agg(F.max("title").alias("title"), line(0).alias("h"), line(1).alias("sizes"), line(2).alias("a"), line(3).alias("b"))
    skip = F.when(F.get("h", F.lit(3)).cast("int") > 0, 1).otherwise(0)
    heads = heads.select(
        "path", "frame", "title", F.get("h", F.lit(0)).cast("int").alias("iteration"), _number(F.get("h", F.lit(1))).alias("run_time"), skip.alias("skip"),
        F.when(skip == 1, F.col("b")).otherwise(F.col("a")).alias("names"), F.aggregate("sizes", F.lit(1).cast("long"), lambda x, s: x * s.cast("long")).alias("points"),
    )
    body = rows.select("path", "frame", "line", "t").join(heads, ["path", "frame"])
    body = body.withColumn("point", F.col("line") - 3 - F.col("skip")).where("point >= 0 and point < points")
    values = F.map_from_arrays(F.slice("names", 1, F.size("t")), F.transform("t", _number))
    out = body.select("path", "frame", "title", "iteration", "run_time", "point", values.alias("values"))
    return out if variables is None else out.select(*out.columns[:-1], *(F.col("values")[v].alias(v) for v in variables))


def _tail(skip: int) -> Column:
    return F.transform(F.slice("t", skip + 1, F.greatest(F.size("t") - skip, F.lit(0))), _number)


def _header_numbers(spark: SparkSession, path: str, pattern: str) -> list[float]:
    found = lines(spark, path).where(F.col("value").rlike(pattern)).first()
    return [float(x) for x in found["value"].split("=")[-1].split()] if found else []


def read_array_rows(spark: SparkSession, paths: str | list[str], pattern: str) -> tuple[list[float], DataFrame]:
    """Positions from the header line that matches ``pattern`` (numbers after ``=``), and (path, time, values).

    Rows have year to second and a millisecond, then one value for each position: auroral ovals by longitude, densities
    by L at one local time, or by local time at one L.
    """
    first = paths if isinstance(paths, str) else paths[0]
    places = _header_numbers(spark, first, pattern)
    rows = lines(spark, paths).select("path", tokens(F.col("value")).alias("t")).where((F.size("t") == 7 + len(places)) & F.get("t", F.lit(0)).rlike(r"^\d{4}$"))
    time = _time({p: F.get("t", F.lit(k)) for k, p in enumerate(PARTS)})
    return places, rows.select("path", time.alias("time"), _tail(7).alias("values"))


def read_index_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, element, time, value) of index files: blocks ``#>``, ``#Element: name``, attributes, ``#>``, rows of date, time, value."""
    w = Window.partitionBy("path").orderBy("n")
    rows = numbered(spark, paths).withColumn("element", F.when(F.col("value").rlike(r"^#\s*Element\s*:"), F.trim(F.regexp_extract("value", r":\s*(.*)$", 1))))
    rows = rows.withColumn("element", F.last("element", True).over(w)).where(F.col("element").isNotNull() & ~F.col("value").startswith("#")).withColumn("t", tokens(F.col("value")))
    time = F.try_to_timestamp(F.concat_ws(" ", F.get("t", F.lit(0)), F.get("t", F.lit(1)))).cast("timestamp_ntz")
    return rows.select("path", "element", time.alias("time"), _number(F.get("t", F.lit(2))).alias("value"))


def index_block_lines(df: DataFrame) -> DataFrame:
    """(element, n, value): the text lines of the same layout for rows (element, time, value), in order of element and n."""
    head = F.array(F.lit("#>"), F.concat(F.lit("#Element: "), F.col("element")), F.lit("#>"), F.lit("#yyyy-MM-dd HH:mm value qualifier description"))
    heads = df.select("element").distinct().select("element", F.posexplode(head).alias("n", "value"))
    body = df.withColumn("n", F.row_number().over(Window.partitionBy("element").orderBy("time")) + 3)
    text = F.concat(F.date_format("time", "yyyy-MM-dd HH:mm"), F.lpad(F.format_string("%.1f", F.col("value").cast("double")), 7, " "), F.lit('\t""\t""'))
    return heads.union(body.select("element", "n", text.alias("value")))


def write_index_blocks(df: DataFrame, path: str) -> None:
    """One file for each element, so that blocks stay whole; files of elements are written by different tasks."""
    out = index_block_lines(df).withColumn("part", F.col("element"))
    out.repartition("element").sortWithinPartitions("element", "n").select("part", "value").write.partitionBy("part").mode("overwrite").text(path)


def read_daily_drivers(spark: SparkSession, paths: str | list[str], header: dict | None = None) -> DataFrame:
    """The JSON-headed hourly driver files: density and speed renamed, arrays cut into numbered columns, status as Qbits."""
    from tideframe.sources.text import json_header, read_json_headed

    first = paths if isinstance(paths, str) else paths[0]
    header = header or json_header(spark, first)
    rows = read_json_headed(spark, paths, header=header)
    size = {n: int(np.ravel(v.get("DIMENSION", [1]))[0]) for n, v in header.items() if isinstance(v, dict)}
    renamed = {"Den_P": "dens", "Vsw": "velo"}
    plain = lambda c: c.removesuffix("_status") if c.endswith("_status") else c
    out, bits = [], []
    for c in rows.columns:
        n = size.get(c, 1)
        if c.endswith("_status"):
            name = renamed.get(plain(c), plain(c))
            bits += [F.get(c, F.lit(k)).cast("double").cast("tinyint").alias(f"{name}{k + 1}") for k in range(n)] if n > 1 else [F.col(c).cast("double").cast("tinyint").alias(name)]
        elif n > 1:
            out += [F.get(c, F.lit(k)).alias(f"{c}{k + 1}") for k in range(n)]
        else:
            out.append(F.col(c).alias(renamed.get(c, c)))
    return rows.select(*out, *([F.struct(*bits).alias("Qbits")] if bits else []))


def read_field_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, time, internal, external) of rows of a date, the internal field's three components and the external one's."""
    rows = lines(spark, paths).select("path", tokens(F.col("value")).alias("t")).where((F.size("t") >= 12) & F.get("t", F.lit(0)).rlike(r"^\d{4}$"))
    time = _time({p: F.get("t", F.lit(k)) for k, p in enumerate(PARTS[:6])})
    vector = lambda k: F.transform(F.slice("t", k, 3), _number)
    return rows.select("path", time.alias("time"), vector(7).alias("internal"), vector(10).alias("external"))


def read_potential(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, l, phi, mlt, potential): L, an angle and a potential a row; the last header line tells if angles are local times."""
    first = paths if isinstance(paths, str) else paths[0]
    heads = [r["value"] for r in numbered(spark, first).orderBy("n").limit(20).collect()]
    heads = [h for h in heads if not all(x.replace(".", "").lstrip("+-").upper().replace("E+", "").replace("E-", "").isdigit() for x in h.split())]
    local = bool(heads) and "mlt" in heads[-1].lower()
    t = [_number(F.get("t", F.lit(k))) for k in range(3)]
    rows = lines(spark, paths).select("path", tokens(F.col("value")).alias("t")).where(F.size("t") >= 3).select("path", *(c.alias(n) for c, n in zip(t, ("l", "angle", "potential"), strict=True)))
    rows = rows.where("l is not null and angle is not null and potential is not null")
    turn = np.pi / 12.0
    phi, mlt = (F.col("angle") * turn, F.col("angle")) if local else (F.col("angle"), F.col("angle") / turn)
    return rows.select("path", "l", phi.alias("phi"), mlt.alias("mlt"), "potential")


def read_boundary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, elapsed, time, values by name) of boundary files: a line of elapsed seconds and date, units, names, rows.

    A value of asterisks did not fit its field and counts as 100000. Many files of one run stack by their time.
    """
    rows = numbered(spark, paths).withColumn("t", tokens(F.col("value")))
    line = lambda k: F.max(F.when(F.col("n") == k, F.col("t")))
    heads = rows.where("n < 3").groupBy("path").agg(line(0).alias("h"), line(2).alias("names"))
    time = _time({p: F.get("h", F.lit(k + 1)) for k, p in enumerate(PARTS[:6])})
    heads = heads.select("path", _number(F.get("h", F.lit(0))).alias("elapsed"), time.alias("time"), "names")
    value = lambda x: F.when(x.rlike(r"^\*+$"), 100000.0).otherwise(_number(x))
    body = rows.where("n > 2").select("path", "n", "t").join(heads, "path")
    return body.select("path", "elapsed", "time", (F.col("n") - 3).alias("point"), F.map_from_arrays(F.slice("names", 1, F.size("t")), F.transform("t", value)).alias("values"))


def pressure_name(name: str) -> str:
    """Short names of pressure columns: without the leading p, lower case, with the species; electrons as e."""
    kind, _, species = name.partition("_")
    kind = kind[1:].lower() if kind[:1].lower() == "p" else kind.lower()
    return {"lsh": "L"}.get(kind, kind) + ("e" if species.lower() == "e" else species)


def read_pressure(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, columns) of pressure tables: a title, names with a unit at the end, rows; names are shortened."""
    first = paths if isinstance(paths, str) else paths[0]
    names = numbered(spark, first).where("n = 1").first()["value"].split()[:-1]
    rows = lines(spark, paths).select("path", tokens(F.col("value")).alias("t")).where((F.size("t") >= len(names)) & _number(F.get("t", F.lit(0))).isNotNull())
    return rows.select("path", *(_number(F.get("t", F.lit(k))).alias(pressure_name(n)) for k, n in enumerate(names)))


def write_boundary(df: DataFrame, path: str, names: list[str], units: str) -> None:
    """The inverse of ``read_boundary``: one file for each time of rows (elapsed, time, point, ``names``)."""
    head = F.array(
        F.concat_ws(" ", F.format_string("%.5E", "elapsed"), F.date_format("time", "yyyy MM dd HH mm ss")), F.lit(f" Units are {units}"), F.concat(F.lit(" "), F.lit(" ".join(names)))
    )
    heads = df.select("elapsed", "time").distinct().select("time", F.posexplode(head).alias("n", "value"))
    row = F.concat_ws(" ", *(F.format_string("%.15E", F.col(c).cast("double")) for c in names))
    rows = heads.union(df.select("time", (F.col("point") + 3).cast("int").alias("n"), row.alias("value")))
    rows = rows.withColumn("part", F.date_format("time", "yyyyMMddHHmmss"))
    rows.repartition("part").sortWithinPartitions("part", "n").select("part", "value").write.partitionBy("part").mode("overwrite").text(path)


def read_ionosphere(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, time, title, iteration, run_time, tilt, hemisphere, point, values by name) of hemisphere files.

    Sections stand under their names in capitals; the points of a hemisphere stand line by line or, where lines were
    wrapped, over as many lines as its variables need.
    """
    piece = F.floor(F.col("n") / PIECE)
    rows = numbered(spark, paths).withColumn("value", F.trim("value"))
    named = F.when(F.col("value").rlike(r"^[A-Z][A-Z ]+$"), F.col("value"))
    rows = carried(rows, ("path",), "n", {"section": named}, piece).where(F.col("value") != F.col("section"))
    rows = row_numbers(rows, ["n"], piece, "k", ("path", "section")).withColumn("t", tokens(F.col("value")))
    first = lambda section, k: F.max(F.when((F.col("section") == section) & (F.col("k") == k), F.get("t", F.lit(0))))
    names = F.array_sort(F.collect_list(F.when(F.col("section") == "VARIABLE LIST", F.struct("k", F.lower(F.trim(F.regexp_extract("value", r"^\d+\s+([^\[]+)\[", 1))).alias("name")))))
    heads = rows.groupBy("path").agg(
        F.max(F.when((F.col("section") == "TITLE") & (F.col("k") == 0), F.regexp_extract("value", '"(.*)"', 1))).alias("title"), *(first("TIME", k).alias(p) for k, p in enumerate(PARTS)),
        _number(first("SIMULATION", 0)).cast("long").alias("iteration"), _number(first("SIMULATION", 1)).alias("run_time"), F.array(_number(first("DIPOLE TILT", 0)), _number(first("DIPOLE TILT", 1))).alias("tilt"),
        F.transform(names, lambda s: s["name"]).alias("names"),
    )
    heads = heads.select("path", _time({p: F.col(p) for p in PARTS}).alias("time"), "title", "iteration", "run_time", "tilt", "names")
    body = rows.where(F.col("section").rlike("^BEGIN .* HEMISPHERE$")).select("path", "k", "t", F.lower(F.regexp_extract("section", "^BEGIN (.*) HEMISPHERE$", 1)).alias("hemisphere")).join(heads, "path")
    # the first lines of a hemisphere tell over how many a point is wrapped: a point's lines hold all its values
    body = body.withColumn("_piece", F.floor(F.col("k") / PIECE))
    back = lambda *by: Window.partitionBy("path", "hemisphere", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    pieces = body.groupBy("path", "hemisphere", "_piece").agg(F.sum(F.size("t")).alias("_sum")).select("path", "hemisphere", "_piece", F.coalesce(F.sum("_sum").over(back("_piece")), F.lit(0)).alias("_back"))
    body = body.withColumn("before", F.coalesce(F.sum(F.size("t")).over(back("_piece", "k")), F.lit(0))).join(pieces, ["path", "hemisphere", "_piece"])
    body = body.withColumn("before", F.col("before") + F.col("_back")).withColumn("point", F.floor(F.col("before") / F.size("names")))
    cells = F.array_sort(F.collect_list(F.struct("k", "t")))
    points = body.groupBy("path", "time", "title", "iteration", "run_time", "tilt", "hemisphere", "point", "names").agg(F.flatten(F.transform(cells, lambda s: s["t"])).alias("t"))
    values = F.map_from_arrays("names", F.transform(F.slice("t", 1, F.size("names")), _number))
    return points.where(F.size("t") == F.size("names")).select("path", "time", "title", "iteration", "run_time", "tilt", "hemisphere", F.col("point").cast("int").alias("point"), values.alias("values"))


def read_geosynchronous(spark: SparkSession, paths: str | list[str], energies: int = 36) -> DataFrame:
    """(path, particle, time, local_time, energy, satellites, flux) of flux tables of geosynchronous satellites.

    Three lines of title, a line with the energies at its end, then for each time and local time the fixed columns: the
    numbers of satellites two characters wide from the 33rd on, the fluxes 18 wide from the 105th on.
    """
    rows = numbered(spark, paths)
    line = lambda k: F.max(F.when(F.col("n") == k, F.col("value")))
    heads = rows.where("n < 4").groupBy("path").agg(line(0).alias("title"), line(3).alias("grid"))
    heads = heads.select("path", F.when(F.instr("title", "electron") > 1, "electron").otherwise("proton").alias("particle"), F.transform(F.slice(tokens(F.col("grid")), -energies, energies), _number).alias("energies"))
    body = rows.where("n > 3").join(heads, "path")
    stamp = F.regexp_replace(F.substring_index(F.ltrim("value"), " ", 1), "Z$", "")
    cell = lambda k, first, wide: F.trim(F.substr("value", F.lit(first) + k * wide, F.lit(wide)))
    body = body.select("path", "particle", F.try_to_timestamp(stamp).cast("timestamp_ntz").alias("time"), F.get(tokens(F.col("value")), F.lit(1)).try_cast("double").alias("local_time"), "value", F.posexplode("energies").alias("e", "energy"))
    return body.select("path", "particle", "time", "local_time", "energy", cell(F.col("e"), 33, 2).try_cast("int").alias("satellites"), _number(cell(F.col("e"), 105, 18)).alias("flux"))


def read_boundary_flux(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, species, time, run_time, energy, local_time, flux): rows of an energy and a flux for each local time around the clock."""
    rows = numbered(spark, paths).withColumn("t", tokens(F.col("value")))
    heads = rows.where("n = 0").select("path", _number(F.element_at("t", -1)).alias("run_time"))
    found = lambda k: F.regexp_extract("path", r"ds(\w{2})_d(\d{8})_t(\d{6})", k)
    body = rows.where("n > 0").join(heads, "path").select("path", "run_time", _number(F.get("t", F.lit(0))).alias("energy"), (F.size("t") - 1).alias("m"), F.posexplode(F.slice("t", 2, F.size("t") - 1)).alias("j", "x"))
    time = F.try_to_timestamp(F.nullif(F.concat(found(2), found(3)), F.lit("")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    hours = F.coalesce(F.try_divide(F.lit(24.0) * F.col("j"), F.col("m") - 1), F.lit(0.0))
    return body.select("path", F.nullif(F.regexp_replace(found(1), "_", ""), F.lit("")).alias("species"), time.alias("time"), "run_time", "energy", hours.alias("local_time"), _number(F.col("x")).alias("flux"))


def read_boundary_columns(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, row, local_time, column, flux): a title, rows of two leading fields and a flux for each energy, a closing line."""
    rows = numbered(spark, paths).withColumn("last", F.max("n").over(Window.partitionBy("path")))
    body = rows.where("n > 0 and n < last").select("path", (F.col("n") - 1).alias("row"), (F.col("last") - 1).alias("m"), tokens(F.col("value")).alias("t"))
    cells = body.select("path", "row", "m", F.posexplode(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))).alias("column", "x"))
    return cells.select("path", "row", F.coalesce(F.try_divide(F.lit(24.0) * F.col("row"), F.col("m") - 1), F.lit(0.0)).alias("local_time"), "column", _number(F.col("x")).alias("flux"))


def read_field_lines(spark: SparkSession, paths: str | list[str], start: str = "2000-01-01 00:00:00") -> DataFrame:
    """(path, time, point, altitude, values by name) of field-line output: frames of five header lines and a line for each altitude.

    A header holds the title, the seconds since ``start`` as second field, the number of altitudes, one more line and the
    names. Names of logarithmic densities, ``lgn...``, also give the densities ``n...``. Many lines' files are one table.
    """
    rows = numbered(spark, paths).withColumn("t", tokens(F.col("value")))
    heads = rows.groupBy("path").agg(F.max(F.when(F.col("n") == 2, F.get("t", F.lit(0)).try_cast("int"))).alias("m"), F.max(F.when(F.col("n") == 4, F.col("t"))).alias("names"))
    rows = rows.join(heads, "path").withColumns({"frame": F.floor(F.col("n") / (F.col("m") + 5)), "line": F.col("n") % (F.col("m") + 5)})
    times = rows.where("line = 1").select("path", "frame", F.timestamp_add("MICROSECOND", F.round(_number(F.get("t", F.lit(1))) * 1e6).cast("long"), F.lit(start).cast("timestamp_ntz")).alias("time"))
    body = rows.where("line > 4").join(times, ["path", "frame"])
    names, numbers = F.slice("names", 2, F.size("t") - 1), F.transform(F.slice("t", 2, F.size("t") - 1), _number)
    plain = F.map_from_arrays(names, numbers)
    logs = F.map_filter(plain, lambda k, v: k.startswith("lgn"))
    values = F.map_concat(plain, F.map_from_arrays(F.transform(F.map_keys(logs), lambda k: F.substring(k, 3, 99)), F.transform(F.map_values(logs), lambda v: F.pow(F.lit(10.0), v))))
    return body.select("path", "time", (F.col("line") - 5).cast("int").alias("point"), _number(F.get("t", F.lit(0))).alias("altitude"), values.alias("values"))


def read_plasma_plane(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, time, i, j, l, mlt, values by name) of a model's equatorial plane: a line of time and sizes, names, rows.

    Densities become per cm3, potentials kV; L comes from the latitude ``theta``, local time from the longitude ``phi``.
    """
    rows = numbered(spark, paths).withColumn("t", tokens(F.col("value")))
    heads = rows.where("n < 2").groupBy("path").agg(F.max(F.when(F.col("n") == 0, F.get("t", F.lit(0)))).alias("stamp"), F.max(F.when(F.col("n") == 1, F.col("t"))).alias("names"))
    time = F.try_to_timestamp(F.regexp_extract("stamp", r"T=(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")
    body = rows.where("n > 1").join(heads.select("path", time.alias("time"), F.transform(F.slice("names", 3, F.size("names")), lambda x: F.lower(x)).alias("names")), "path")
    scale = F.create_map(F.lit("n"), F.lit(1e-6), F.lit("pot"), F.lit(1e-3), F.lit("corot"), F.lit(1e-3))
    values = F.map_from_arrays("names", F.zip_with("names", F.slice("t", 3, F.size("names")), lambda k, x: _number(x) * F.coalesce(F.try_element_at(scale, k), F.lit(1.0))))
    body = body.select("path", "time", *((F.get("t", F.lit(k)).cast("int") - 1).alias(c) for k, c in enumerate("ij")), values.alias("values"))
    theta = F.cos(F.radians(F.col("values")["theta"]))
    return body.select("path", "time", "i", "j", (1 / (theta * theta)).alias("l"), (F.col("values")["phi"] / 15.0).alias("mlt"), "values")


def read_density_slices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, fixed, time, position, density) of plasma slices: densities by L at one local time, or by local time at one L.

    A file begins with the place that is fixed (the last number of its first line) and the positions across (all numbers of
    the second); a row has year to second, a millisecond and a density for each position. Files split; their heads are
    found by what their lines hold, so many files, each with positions of its own, are read at once.
    """
    rows = lines(spark, paths).where("value <> ''").select("path", tokens(F.col("value")).alias("t"))
    number = r"^[-+]?(\d+\.?\d*|\.\d+)([eEdD][-+]?\d+)?$"
    row = (F.size("t") >= 8) & F.get("t", F.lit(0)).rlike(r"^\d{4}$") & F.forall(F.slice("t", 2, 6), lambda x: x.rlike(r"^\d{1,3}$"))
    heads = rows.where(~row).select("path", F.transform(F.filter("t", lambda x: x.rlike(number)), _number).alias("x")).where(F.size("x") > 0)
    heads = heads.groupBy("path").agg(F.min_by("x", F.size("x")).alias("one"), F.max_by("x", F.size("x")).alias("places"))
    time = _time({p: F.get("t", F.lit(k)) for k, p in enumerate(PARTS)})
    body = rows.where(row).select("path", time.alias("time"), _tail(7).alias("v"))
    out = body.join(heads, "path").select("path", F.element_at("one", -1).alias("fixed"), "time", F.explode(F.arrays_zip(F.col("places").alias("position"), F.col("v").alias("density"))).alias("c"))
    return out.select("path", "fixed", "time", "c.position", "c.density")
