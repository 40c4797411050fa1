"""Readers and writers of scientific text layouts.

Layouts whose rows explain themselves are read line by line, so that large files split. Where a file's first lines name
its columns, one reader call takes files of one header, read from one of them on the driver (a header is some lines), or
the file is read whole and cut into numbered lines in the tasks.
"""

from __future__ import annotations

import itertools
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines in which a file's header ends.
HEADER_LINES = 5000
PARTS = ("year", "month", "day", "hour", "minute", "second", "milli")
_SHORT = {"year": ("year", "yyyy", "yr"), "month": ("mo", "month", "mm"), "day": ("dy", "day", "dd"), "hour": ("hr", "hour", "hh"), "minute": ("mn", "min", "minute", "mi"), "second": ("sc", "sec", "second", "ss"), "milli": ("msc", "ms", "millisecond")}


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, value) of all lines; files split."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")


def numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, n, value) of the lines that are not empty; n from 0 counts these too.

    Files are read in splits: lines are numbered within theirs and shifted by the lines of the splits before, of which there
    is a row each. No task holds a file.
    """
    from pyspark.sql import Window

    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), "value").withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy("path", "_b").agg(F.min("_id").alias("_first"), F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "_b", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.where("value <> ''").join(blocks, ["path", "_b"]).select("path", (F.col("_id") + F.col("_shift")).cast("int").alias("n"), "value")


def tokens(value: Column) -> Column:
    """Fields between white space or commas."""
    return F.filter(F.split(value, r"[\s,]+"), lambda x: x != "")


def _number(x: Column) -> Column:
    return F.regexp_replace(x, "[dD]", "E").try_cast("double")


def _time(part: dict[str, Column]) -> Column:
    """timestamp_ntz of calendar columns."""
    whole = F.make_timestamp_ntz(*(part[p].cast("int") for p in PARTS[:5]), part["second"].cast("decimal(16,6)"))
    return F.timestamp_add("MICROSECOND", (part["milli"].cast("double") * 1000).cast("long"), whole) if "milli" in part else whole


def json_header(spark: SparkSession, path: str) -> dict:
    """The JSON that stands behind ``#`` at the top of a file."""
    head = [r["value"].lstrip() for r in spark.read.text(path).limit(HEADER_LINES).collect()]
    text = "\n".join(x[1:] for x in itertools.takewhile(lambda x: x.startswith("#") or not x, head))
    try:
        return json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        # commas after the last entry and missing ones between entries are common in the wild
        text = re.sub(r",(\s*[}\]])", r"\1", text[text.index("{") : text.rindex("}") + 1])
        return json.loads(re.sub(r"([}\]\"0-9])(\s*\n\s*\")", r"\1,\2", text))


def read_json_headed(spark: SparkSession, paths: str | list[str], restrict: list[str] | None = None, header: dict | None = None) -> DataFrame:
    """A white-space table whose columns a JSON header tells; entries with DIMENSION over 1 become arrays.

    ``restrict`` keeps the named columns alone. Attributes go to the columns' metadata.
    """
    header = header or json_header(spark, paths if isinstance(paths, str) else paths[0])
    cells = lines(spark, paths).where(~F.ltrim("value").startswith("#") & (F.trim("value") != "")).select(tokens(F.col("value")).alias("t"))
    columns = []
    for name, about in header.items():
        if not isinstance(about, dict) or "START_COLUMN" not in about or (restrict is not None and name not in restrict):
            continue
        start, shape = int(about["START_COLUMN"]), about.get("DIMENSION", [1])
        n = int(shape[0] if isinstance(shape, list) else shape)
        meta = {k: v for k, v in about.items() if k not in ("START_COLUMN", "DIMENSION", "VALUES")}
        first = F.get("t", F.lit(start))
        if n > 1:
            column = F.transform(F.slice("t", start + 1, n), _number)
        elif "ISO" in json.dumps(meta).upper():
            column = F.try_to_timestamp(first).cast("timestamp_ntz")
        else:
            column = _number(first)
        columns.append(column.alias(name, metadata=json.loads(json.dumps(meta))))
    return cells.select(*columns)


def _headed(head: list[str]):
    """Puts header lines before the rows of each partition, so of each file."""

    def job(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], schema=batch.schema)
                first = False
            yield batch

    return job


def json_header_text(df: DataFrame, sizes: dict[str, int]) -> list[str]:
    """Header lines of a table: columns in order with where they start; ``sizes`` of array columns."""
    at, about = 0, {}
    for f in df.schema.fields:
        n = sizes.get(f.name, 1)
        about[f.name] = {**f.metadata, "START_COLUMN": at, **({"DIMENSION": [n]} if n > 1 else {})}
        at += n
    return [f"# {x}" for x in json.dumps(about, indent=1, default=str).splitlines()]


def write_json_headed(df: DataFrame, path: str, sizes: dict[str, int] | None = None, delimiter: str = " ") -> None:
    """One header line group in each file, then the rows; times as ISO."""
    sizes = sizes or {}

    def cell(f) -> Column:
        if f.name in sizes:
            return F.array_join(F.transform(f.name, lambda x: x.cast("string")), delimiter)
        kind = f.dataType.simpleString()
        return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else F.col(f.name).cast("string")

    head = json_header_text(df, sizes)
    df.select(F.concat_ws(delimiter, *(cell(f) for f in df.schema.fields)).alias("value")).mapInArrow(_headed(head), "value string").write.text(path)


def read_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Model logs: a title, a line of names, rows. Calendar columns become ``time``; ``runtime`` counts seconds from the first row.

    A last line that was cut off is dropped; stars in place of an iteration become -1.
    """
    rows = numbered(spark, paths)
    first = paths if isinstance(paths, str) else paths[0]
    names = numbered(spark, first).where("n = 1").first()["value"].split()
    t = tokens(F.col("value"))
    table = rows.where("n > 1").select("path", "n", t.alias("t")).where(F.size("t") == len(names))
    value = lambda k: F.when(F.get("t", F.lit(k)).contains("*"), -1.0).otherwise(_number(F.get("t", F.lit(k))))
    index = {n.lower(): k for k, n in enumerate(names)}
    part = {p: value(index[s]) for p, short in _SHORT.items() for s in short if s in index}
    used = {index[s] for short in _SHORT.values() for s in short if s in index} if {"year", "month", "day"} <= part.keys() else set()
    columns = [value(k).alias(n) for k, n in enumerate(names) if k not in used]
    if used:
        table = table.select("path", "n", _time(part).alias("time"), *columns)
        from pyspark.sql import Window

        start = F.first("time").over(Window.partitionBy("path").orderBy("n"))
        return table.withColumn("runtime", F.timestamp_diff("MICROSECOND", start, F.col("time")) / 1e6).drop("n")
    return table.select("path", *columns)


def read_series(spark: SparkSession, paths: str | list[str], names: list[str], marker: str = "#START") -> DataFrame:
    """Input files with keyword blocks: rows after ``marker`` are seven calendar numbers and then ``names``."""
    rows = numbered(spark, paths)
    start = rows.where(F.trim("value").startswith(marker)).groupBy("path").agg(F.max("n").alias("start"))
    table = rows.join(start, "path").where("n > start").select("path", tokens(F.col("value")).alias("t")).where(F.size("t") >= 7 + len(names))
    part = {p: _number(F.get("t", F.lit(k))) for k, p in enumerate(PARTS)}
    return table.select("path", _time(part).alias("time"), *(_number(F.get("t", F.lit(7 + k))).alias(n) for k, n in enumerate(names)))


def read_solar_wind(spark: SparkSession, paths: str | list[str], names: list[str] | None = None) -> DataFrame:
    """Solar wind input; the columns are the usual eight, or those of a ``#VAR`` block in the first file."""
    if names is None:
        head = numbered(spark, paths if isinstance(paths, str) else paths[0])
        at = head.where(F.trim("value").startswith("#VAR")).agg(F.max("n")).first()[0]
        line = head.where(F.col("n") == at + 1).first()["value"] if at is not None else "bx by bz ux uy uz rho temp"
        names = line.split()
    return read_series(spark, paths, names)


def read_orbit(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Satellite orbits: calendar numbers and x, y, z after ``#START``; the system stands after ``#COOR``."""
    rows = numbered(spark, paths)
    mark = rows.where(F.trim("value").startswith("#COOR")).select("path", (F.col("n") + 1).alias("n"))
    system = rows.join(mark, ["path", "n"]).select("path", F.trim("value").alias("system"))
    return read_series(spark, paths, ["x", "y", "z"]).join(F.broadcast(system), "path", "left")


def write_series(df: DataFrame, path: str, time: str, names: list[str], head: tuple[str, ...] = ("#START",)) -> None:
    """The inverse of ``read_series`` into one file per partition."""
    row = F.concat_ws(" ", F.date_format(time, "yyyy MM dd HH mm ss SSS"), *(F.col(n).cast("string") for n in names)).alias("value")

    df.select(row).mapInArrow(_headed(list(head)), "value string").write.text(path)


def read_stations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Station files: ``n magnetometers: names``, a line of names, rows with a 1-based station number."""
    rows = numbered(spark, paths)
    stations = rows.where("n = 0").select("path", tokens(F.substring_index("value", ":", -1)).alias("stations"))
    names = numbered(spark, paths if isinstance(paths, str) else paths[0]).where("n = 1").first()["value"].split()
    k = names.index("station")
    table = rows.where("n > 1").select("path", tokens(F.col("value")).alias("t")).where(F.size("t") == len(names)).join(F.broadcast(stations), "path")
    cell = lambda i: _number(F.get("t", F.lit(i)))
    part = {p: cell(names.index(s)) for p, short in _SHORT.items() for s in short if s in names}
    station = F.get("stations", cell(k).cast("int") - 1).alias("station")
    return table.select("path", _time(part).alias("time"), station, *(cell(i).alias(n) for i, n in enumerate(names) if i > k))


def read_hourly_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Fixed-width days of 24 hourly values: (time, value)."""
    v = F.col("value")
    rows = lines(spark, paths).where(F.length("value") >= 116)
    century = F.coalesce(F.trim(F.substring(v, 15, 2)).try_cast("int"), F.lit(19)) * 100
    day = F.make_date(century + F.substring(v, 4, 2).try_cast("int"), F.substring(v, 6, 2).try_cast("int"), F.substring(v, 9, 2).try_cast("int"))
    hours = rows.select(day.alias("day"), "value", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    cell = F.trim(F.substr("value", F.col("h") * 4 + 21, F.lit(4))).try_cast("double")
    return hours.select(F.timestamp_add("HOUR", F.col("h"), F.col("day").cast("timestamp_ntz")).alias("time"), cell.alias("value"))


def read_three_hourly_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Days of eight three-hour values with thirds as + and -: (start, time, stop, value)."""
    rows = lines(spark, paths).where(F.col("value").rlike(r"^\d{8}"))
    parts = rows.select(F.to_date(F.substring("value", 1, 8), "yyyyMMdd").cast("timestamp_ntz").alias("day"), "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    sign = F.substr("value", F.col("j") * 2 + 11, F.lit(1))
    value = F.substr("value", F.col("j") * 2 + 10, F.lit(1)).try_cast("double") + F.when(sign == "-", -1 / 3).when(sign == "+", 1 / 3).otherwise(0.0)
    at = lambda minutes: F.timestamp_add("MINUTE", F.col("j") * 180 + minutes, F.col("day"))
    return parts.select(at(0).alias("start"), at(90).alias("time"), at(180).alias("stop"), value.alias("value"))


def read_iaga(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """IAGA-2002 rows: (path, time, doy, values); lines that end in | are headers."""
    first = paths if isinstance(paths, str) else paths[0]
    head = lines(spark, first).where(F.rtrim("value").endswith("|") & F.ltrim("value").startswith("DATE")).first()["value"]
    names = [n.lower() for n in head.replace("|", " ").split()[3:]]
    rows = lines(spark, paths).where(~F.rtrim("value").endswith("|") & F.ltrim("value").rlike(r"^\d{4}-")).select("path", tokens(F.col("value")).alias("t"))
    time = F.try_to_timestamp(F.concat_ws(" ", F.get("t", F.lit(0)), F.get("t", F.lit(1)))).cast("timestamp_ntz")
    return rows.select("path", time.alias("time"), F.get("t", F.lit(2)).try_cast("int").alias("doy"), *(_number(F.get("t", F.lit(3 + k))).alias(n) for k, n in enumerate(names)))


def read_flux_table(spark: SparkSession, paths: str | list[str], lead: list[str], energies: list[float]) -> DataFrame:
    """``#`` comments and rows of ``lead`` columns and one flux for each energy: (path, percentile, lead, flux map by energy)."""
    rows = lines(spark, paths).where(~F.ltrim("value").startswith("#") & (F.trim("value") != "")).select("path", tokens(F.col("value")).alias("t"))
    n = len(lead)
    whole = F.size("t") >= n + len(energies)
    flux = F.when(whole, F.map_from_arrays(F.array(*map(F.lit, energies)), F.transform(F.slice("t", n + 1, len(energies)), _number)))
    percentile = F.regexp_extract("path", r"pctile_flux_(\d+)", 1).try_cast("int")
    return rows.select("path", percentile.alias("percentile"), *(_number(F.get("t", F.lit(k))).alias(c) for k, c in enumerate(lead)), flux.alias("flux"))


def combine_percentiles(flux: DataFrame) -> DataFrame:
    """Mean flux by energy and percentile, percentiles as columns in falling order."""
    rows = flux.select("percentile", F.explode("flux").alias("energy", "value"))
    steps = sorted((r[0] for r in rows.select("percentile").distinct().collect()), reverse=True)
    return rows.groupBy("energy").pivot("percentile", steps).avg("value")


def read_epochs(spark: SparkSession, paths: str | list[str], iso: bool = False) -> DataFrame:
    """Epochs from ``Y M D h m s`` rows or ISO texts."""
    rows = lines(spark, paths).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    if iso:
        return rows.select(F.try_to_timestamp(F.trim("value")).cast("timestamp_ntz").alias("epoch"))
    t = rows.select(tokens(F.col("value")).alias("t"))
    return t.select(_time({p: _number(F.get("t", F.lit(k))) for k, p in enumerate(PARTS[:6])}).alias("epoch"))


def file_times(path: Column) -> Column:
    """struct(iteration, runtime seconds, event time) from names with _n, _t and _e parts; null where missing."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    t, e = found(r"_t(\d{8})(?:\D|$)"), found(r"_e(\d{8}-\d{6})")
    seconds = F.substring(t, 1, 4).cast("int") * 3600 + F.substring(t, 5, 2).cast("int") * 60 + F.substring(t, 7, 2).cast("int")
    return F.struct(found(r"_n(\d+)").cast("long").alias("iteration"), seconds.alias("runtime"), F.try_to_timestamp(e, F.lit("yyyyMMdd-HHmmss")).cast("timestamp_ntz").alias("time"))


_FORMATS = {"%Y": r"\d{4}", "%m": r"\d{2}", "%d": r"\d{2}", "%H": r"\d{2}", "%M": r"\d{2}", "%S": r"\d{2}", "%j": r"\d{3}", "%y": r"\d{2}", "%b": "[A-Z][a-z]{2}"}


def path_pattern(pattern: str, when=None) -> str:
    """A regular expression from one with strftime fields; with a datetime these are filled in."""
    out = ""
    for part in re.split(r"(%[a-zA-Z%])", pattern):
        out += part if not part.startswith("%") else "%" if part == "%%" else when.strftime(part) if when else _FORMATS[part]
    return f"^{out}$"


def matching_files(spark: SparkSession, root: str, pattern: str, when=None) -> DataFrame:
    """(path) of the files under ``root`` whose path from there matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/*", "")
    return files.where(below.rlike(path_pattern(pattern, when)))


def concat_files(spark: SparkSession, paths: list[str], sort: str | None = None) -> DataFrame:
    """Parquet files of like columns as one table, in order of a column if named; missing columns are null."""
    out = spark.read.option("mergeSchema", "true").parquet(*paths)
    return out.orderBy(sort) if sort else out


def path_slice(path: Column, start: int, stop: int | None = None, step: int | None = None) -> Column:
    """Elements of a path as in Python's slices; a single one without ``stop`` and ``step``."""
    parts = F.split(path, "/")
    n = F.size(parts)
    if stop is None and step is None:
        return F.get(parts, F.lit(start) if start >= 0 else n + start)
    place = lambda k, default: default if k is None else F.lit(k) if k >= 0 else n + k
    low, high = place(start, F.lit(0)), F.least(place(stop, n), n)
    chosen = F.filter(parts, lambda x, i: (i >= low) & (i < high) & (F.pmod(i - low, F.lit(step or 1)) == 0))
    return F.array_join(chosen, "/")


#: Electron volts of the units of energy.
ENERGY = {"eV": 1.0, "keV": 1e3, "MeV": 1e6, "GeV": 1e9}


def per_energy(energy: Column, flux: Column, unit: str, wanted: str) -> tuple[Column, Column]:
    """(energy, flux) in another unit of energy; flux is per that unit."""
    factor = ENERGY[unit] / ENERGY[wanted]
    return energy * factor, flux / factor


def table_variables(line: str) -> list[str]:
    """Names of a list of quoted variables, each with its unit in brackets: the names alone."""
    return [x.split("[")[0].strip() for x in re.findall(r'"([^"]*)"', line)]


def read_parameters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, component, position, command, argument, value) of parameter files: one row for each argument of a command.

    A command is a line that begins with ``#``; its arguments are the lines below it up to a blank line or the next command,
    numbered from 0. A command without arguments has one row with a null ``argument`` and ``value``. Lines elsewhere are
    remarks. Commands between ``#BEGIN_COMP name`` and ``#END_COMP`` have that ``component``, others null. Files are small
    and read whole; an empty file has no rows.
    """
    return parameters_of(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parameters_of(files: DataFrame) -> DataFrame:
    """What ``read_parameters`` gives, for files (path, value) that are rows of a table: many small files are best kept so."""
    from pyspark.sql import Window

    whole = files.select("path", F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    blocks = whole.select("path", F.posexplode(F.split("value", "(?m)^#")).alias("position", "block")).where("position > 0")
    first = F.trim(F.substring_index("block", "\n", 1))
    bound = F.regexp_extract(first, r"^(?:BEGIN|END)_COMP\b\s*(\w*)", 1)
    blocks = blocks.withColumn("bound", F.when(first.startswith("BEGIN_COMP"), bound).when(first.startswith("END_COMP"), ""))
    before = F.last("bound", ignorenulls=True).over(Window.partitionBy("path").orderBy("position"))
    blocks = blocks.withColumn("component", F.when(before != "", before)).where("bound is null")
    listed = F.split(F.regexp_replace("block", r"(?s)\n[^\S\n]*(?:\n.*)?$", ""), "\n")
    given = F.transform(F.slice(listed, F.lit(2), F.greatest(F.size(listed) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return blocks.select("path", "component", "position", first.alias("command"), F.posexplode_outer(given).alias("argument", "value"))


def run_times(parameters: DataFrame) -> DataFrame:
    """(path, start, iterations, seconds, stop) of the files of ``read_parameters``.

    ``#STARTTIME`` has year, month, day, hour, minute, second and a fraction, ``#STOP`` iterations and seconds; of a command
    that comes again the last one counts. What a file lacks, or has as no number, is null.
    """
    rows = parameters.where(F.col("command").isin("STARTTIME", "STOP")).withColumn("number", _number(F.get(tokens(F.col("value")), F.lit(0))))
    at = lambda command, k: F.max_by("number", F.when((F.col("command") == command) & (F.col("argument") == k), F.col("position")))
    found = rows.groupBy("path").agg(*(at("STARTTIME", k).alias(f"s{k}") for k in range(7)), at("STOP", 0).cast("long").alias("iterations"), at("STOP", 1).alias("seconds"))
    whole = F.try_make_timestamp_ntz(*(F.col(f"s{k}").cast("int") for k in range(5)), F.col("s5").cast("decimal(16,6)"))
    found = found.withColumn("start", F.timestamp_add("MICROSECOND", F.round(F.coalesce("s6", F.lit(0.0)) * 1e6).cast("long"), whole))
    stop = F.timestamp_add("MICROSECOND", F.round(F.col("seconds") * 1e6).cast("long"), F.col("start"))
    return found.select("path", "start", "iterations", "seconds", stop.alias("stop"))
