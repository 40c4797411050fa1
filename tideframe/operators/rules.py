"""Data-quality rules driven by metadata: valid ranges and fill values of columns, and checks on a variable catalogue.

A catalogue is a table (variable, attr, value): attributes of variables as text. Each check gives (variable, rule, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard fill values by type. Fixed values.
FILL = {"byte": -(2**7), "short": -(2**15), "int": -(2**31), "bigint": -(2**63), "float": -1e31, "double": -1e31, "string": " "}
REFERENCES = "^(DEPEND|LABL_PTR)_[0-9]+$|^DELTA_(PLUS|MINUS)_VAR$"


def is_fill(x: Column, fill: float, exact: bool = False) -> Column:
    return x == fill if exact else F.abs(x - fill) <= 1e-8 + 1e-5 * abs(fill)


def replace_invalid(x: Column, fill: float | None = None, low: float | None = None, high: float | None = None, exact: bool = False) -> Column:
    """Null for fill values and values outside [low, high]."""
    bad = F.lit(False)
    if fill is not None:
        bad = bad | is_fill(x, fill, exact)
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return F.when(~bad, x)


def fill_invalid(x: Column, fill: float) -> Column:
    """The inverse: nulls and NaN as the fill value."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(fill))


def out_of_range(df: DataFrame, value: str, fill: float, low: float, high: float) -> DataFrame:
    """(rule, n, least, most) of the non-fill values beyond the limits."""
    x = F.col(value)
    rule = F.when(x < low, "below").when(x > high, "above")
    return df.where(~is_fill(x, fill)).select(rule.alias("rule"), x.alias("x")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def standard_fill(kind: Column) -> Column:
    """The standard fill value of a type, as text."""
    return F.coalesce(*(F.when(kind == t, F.lit(str(v))) for t, v in FILL.items()))


def standard_format(kind: Column, length: Column, low: Column | None = None, high: Column | None = None, scale_low: Column | None = None, scale_high: Column | None = None) -> Column:
    """The format of a type by its limits: whole numbers as wide as these, others with fewer places the wider their range.

    Without limits whole numbers are as wide as the type's and others have a general format; texts are ``length`` wide.
    """
    low, high, scale_low, scale_high = (F.lit(None).cast("double") if x is None else x.cast("double") for x in (low, high, scale_low, scale_high))
    ends = F.coalesce(*(F.when(kind == t, F.struct(F.lit(float(v)).alias("low"), F.lit(float(-v - 1)).alias("high"))) for t, v in FILL.items() if isinstance(v, int)))
    least, most = F.coalesce(low, ends["low"]), F.coalesce(high, ends["high"])
    digits = lambda x: F.floor(F.log10(x)).cast("int")
    whole = F.when(least < 0, digits(F.greatest(F.abs(least), F.abs(most), F.lit(1.0))) + 2).otherwise(F.when(most != 0, digits(most)).otherwise(1) + 1)
    text = lambda x: F.length(x.cast("long").cast("string"))
    spread = F.coalesce(scale_high - scale_low, high - low)
    wide = F.greatest(text(high), text(low))
    places = F.array(*(F.struct(F.lit(m).alias("most"), F.lit(n).alias("n")) for m, n in ((11.0, 3), (101.0, 2), (1000.0, 1))))
    n = F.get(F.filter(places, lambda x: spread <= x["most"]), F.lit(0))["n"]
    real = F.when((spread > 0) & n.isNotNull() & wide.isNotNull(), F.concat(F.lit("F"), (wide + n + 1).cast("string"), F.lit("."), n.cast("string"))).otherwise("G10.2E3")
    return F.when(kind == "string", F.concat(F.lit("A"), length.cast("string"))).when(kind.isin("float", "double"), real).otherwise(F.concat(F.lit("I"), whole.cast("string")))


def deltas(catalogue: DataFrame) -> DataFrame:
    """(variable, attr, other, type, shape): the uncertainties that a variable names and that are there."""
    out = _linked(catalogue, "^DELTA_(PLUS|MINUS)_VAR$")
    for attr in ("TYPE", "SHAPE"):
        out = out.join(_of(catalogue, attr).withColumnRenamed("variable", "other"), "other", "left")
    return out.select("variable", "attr", "other", "type", "shape")


def _of(catalogue: DataFrame, attr: str) -> DataFrame:
    return catalogue.where(F.col("attr") == attr).select("variable", F.col("value").alias(attr.lower()))


def missing_references(catalogue: DataFrame) -> DataFrame:
    """Attributes that name a variable which is not there."""
    names = catalogue.select(F.col("variable").alias("value")).distinct()
    bad = catalogue.where(F.col("attr").rlike(REFERENCES)).join(names, "value", "left_anti")
    return bad.select("variable", F.lit("depends").alias("rule"), F.concat_ws(" ", "attr", F.lit("variable"), "value", F.lit("missing")).alias("message"))


def main_variables(catalogue: DataFrame) -> DataFrame:
    """Variables that no other variable refers to."""
    used = catalogue.where(F.col("attr").rlike(REFERENCES)).select(F.col("value").alias("variable"))
    return catalogue.select("variable").distinct().join(used, "variable", "left_anti")


def empty_entries(catalogue: DataFrame) -> DataFrame:
    return catalogue.where("value = ''").select("variable", F.lit("empty_entry").alias("rule"), F.concat_ws(" ", F.lit("empty attribute"), "attr").alias("message"))


def wrong_fill(catalogue: DataFrame) -> DataFrame:
    """Fill values that are missing or not the standard one of the type."""
    rows = _of(catalogue, "TYPE").join(_of(catalogue, "FILLVAL"), "variable", "left").withColumn("standard", standard_fill(F.col("type")))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    near = F.abs(number("fillval") - number("standard")) <= 1e-7 * F.abs(number("standard"))
    bad = F.when(F.col("fillval").isNull(), "no FILLVAL").when(~F.coalesce(near, F.col("fillval") == F.col("standard"), F.lit(False)), F.concat_ws(" ", F.lit("FILLVAL"), "fillval", F.lit("should be"), "standard"))
    return rows.select("variable", F.lit("fillval").alias("rule"), bad.alias("message")).where("message is not null")


def wrong_limits(catalogue: DataFrame) -> DataFrame:
    """VALIDMIN above VALIDMAX, or SCALEMIN above SCALEMAX."""
    out = None
    for kind in ("VALID", "SCALE"):
        pair = _of(catalogue, f"{kind}MIN").join(_of(catalogue, f"{kind}MAX"), "variable")
        low, high = (F.expr(f"try_cast({kind.lower()}{x} as double)") for x in ("min", "max"))
        bad = pair.where(low > high).select("variable", F.lit(f"{kind.lower()}range").alias("rule"), F.lit(f"{kind}MIN > {kind}MAX").alias("message"))
        out = bad if out is None else out.union(bad)
    return out


def wrong_names(catalogue: DataFrame) -> DataFrame:
    """FIELDNAM that is not the variable's name."""
    return _of(catalogue, "FIELDNAM").where("fieldnam <> variable").select("variable", F.lit("fieldnam").alias("rule"), F.concat_ws(" ", F.lit("FIELDNAM"), "fieldnam").alias("message"))


def _linked(catalogue: DataFrame, pattern: str) -> DataFrame:
    """(variable, attr, other) of the references that match and whose target is there."""
    names = catalogue.select(F.col("variable").alias("other")).distinct()
    return catalogue.where(F.col("attr").rlike(pattern)).select("variable", "attr", F.col("value").alias("other")).join(names, "other")


def wrong_deltas(catalogue: DataFrame) -> DataFrame:
    """Uncertainties whose type, units, shape or number of records isn't that of their variable."""
    refs = _linked(catalogue, "^DELTA_(PLUS|MINUS)_VAR$")
    wide = catalogue.where(F.col("attr").isin("TYPE", "UNITS", "SHAPE", "RECORDS")).groupBy("variable").pivot("attr", ["TYPE", "UNITS", "SHAPE", "RECORDS"]).agg(F.min("value"))
    mine = wide.select("variable", *(F.col(c).alias(f"own_{c}") for c in wide.columns[1:]))
    rows = refs.join(mine, "variable", "left").join(wide.withColumnRenamed("variable", "other"), "other", "left")
    records = F.col("RECORDS").isNotNull() & F.col("own_RECORDS").isNotNull() & (F.col("RECORDS") != F.col("own_RECORDS"))
    differs = {"TYPE": ~F.col("TYPE").eqNullSafe(F.col("own_TYPE")), "UNITS": ~F.col("UNITS").eqNullSafe(F.col("own_UNITS")), "SHAPE": ~F.col("SHAPE").eqNullSafe(F.col("own_SHAPE")), "RECORDS": records}
    found = F.filter(F.array(*(F.when(bad, F.concat_ws(" ", "attr", "other", F.lit(f"differs in {k}"))) for k, bad in differs.items())), lambda m: m.isNotNull())
    return rows.select("variable", F.explode(found).alias("message")).select("variable", F.lit("deltas").alias("rule"), "message")


def wrong_record_count(catalogue: DataFrame) -> DataFrame:
    """Variables with other numbers of records than the variable they are recorded over."""
    records = _of(catalogue, "RECORDS")
    rows = _linked(catalogue, "^DEPEND_0$").join(records, "variable").join(records.select(F.col("variable").alias("other"), F.col("records").alias("there")), "other")
    return rows.where("records <> there").select("variable", F.lit("recordcount").alias("rule"), F.concat_ws(" ", "records", F.lit("records but"), "there", F.lit("of"), "other").alias("message"))


def wrong_sizes(catalogue: DataFrame) -> DataFrame:
    """Dimensions whose size isn't that of the variable they depend on; SHAPE holds sizes between commas.

    A dimension's variable may itself depend on one of lower layer: that one's size is taken out of its shape first.
    """
    sizes = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    shapes = _of(catalogue, "SHAPE").select("variable", sizes(F.col("shape")).alias("shape"))
    refs = _linked(catalogue, "^DEPEND_[1-9]$").withColumn("k", F.substring("attr", 8, 1).cast("int"))
    layer = _of(catalogue, "DEPEND_1").join(shapes.select(F.col("variable").alias("depend_1"), F.col("shape").alias("under")), "depend_1").select(F.col("variable").alias("other"), "under")
    rows = refs.join(shapes, "variable").join(shapes.select(F.col("variable").alias("other"), F.col("shape").alias("there")), "other").join(layer, "other", "left")
    own, under = F.get("shape", F.col("k") - 1), F.get("under", F.lit(0))
    drop = F.array_position("there", under)
    left = F.when(F.col("under").isNull() | (drop == 0), F.col("there")).otherwise(F.filter("there", lambda x, i: i != drop - 1))
    rows = rows.select("variable", "k", "other", own.alias("own"), left.alias("left"))
    bad = F.when(F.size("left") != 1, F.concat_ws(" ", F.lit("dimension"), F.col("k").cast("string"), F.lit("depends on more than one of"), "other"))
    bad = bad.when(F.col("own") != F.get("left", F.lit(0)), F.concat_ws(" ", F.lit("dimension"), F.col("k").cast("string"), F.lit("has"), F.col("own").cast("string"), F.lit("but"), "other", F.get("left", F.lit(0)).cast("string")))
    return rows.select("variable", F.lit("depsize").alias("rule"), bad.alias("message")).where("message is not null")


def wrong_display(catalogue: DataFrame) -> DataFrame:
    """Variables of one value a record that aren't shown as time series, and others that aren't as spectrograms."""
    rows = _of(catalogue, "DISPLAY_TYPE").join(_of(catalogue, "SHAPE"), "variable", "left")
    single = F.coalesce(F.trim("shape"), F.lit("")) == ""
    bad = rows.where(F.col("display_type") != F.when(single, "time_series").otherwise("spectrogram"))
    return bad.select("variable", F.lit("validdisplaytype").alias("rule"), F.concat_ws(" ", F.when(single, "one value").otherwise("many values"), F.lit("a record shown as"), "display_type").alias("message"))


def wrong_file_names(files: DataFrame) -> DataFrame:
    """(path, message) for files (path, logical_source, logical_file_id) whose name doesn't follow their attributes."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    checks = F.array(
        F.when(F.col("logical_source").isNull(), "no Logical_source").when(~name.startswith(F.col("logical_source")), F.concat(F.lit("Logical_source isn't the start of "), name)),
        F.when(F.col("logical_file_id").isNull(), "no Logical_file_id").when(stem != F.col("logical_file_id"), F.concat(F.lit("Logical_file_id isn't the stem of "), name)),
    )
    return files.select("path", F.explode(F.filter(checks, lambda m: m.isNotNull())).alias("message"))


def wrong_file_days(rows: DataFrame, path: str, ts: str) -> DataFrame:
    """(path, days, message): files with times of several days, or of another day than the eight digits in their name."""
    days = rows.groupBy(path).agg(F.count_distinct(F.to_date(ts)).alias("days"), F.min(F.date_format(ts, "yyyyMMdd")).alias("day"))
    digits = F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"\d{8}", 0)
    bad = F.when(digits == "", "no date in the name").when(F.col("days") > 1, "several days").when(F.col("day") != digits, "another day")
    return days.select(path, "days", bad.alias("message")).where("message is not null")


CHECKS = (missing_references, empty_entries, wrong_fill, wrong_limits, wrong_names, wrong_deltas, wrong_record_count, wrong_sizes, wrong_display)


def all_checks(catalogue: DataFrame) -> DataFrame:
    out = CHECKS[0](catalogue)
    for check in CHECKS[1:]:
        out = out.union(check(catalogue))
    return out


def attributes(kind: str = "data", dimensions: int = 1, fixed: bool = False, type: str = "float") -> dict[str, object]:
    """The attributes that a variable of a kind (data, support_data, metadata) should have, with what can be said beforehand.

    ``fixed`` variables do not vary from record to record. Blank texts are to be filled in.
    """
    if kind not in ("data", "support_data", "metadata"):
        raise ValueError("kinds are data, support_data and metadata")
    fill = {"char": " ", "int": FILL["bigint"], "tt2000": FILL["bigint"]}.get(type, -1e31)
    out: dict[str, object] = {"CATDESC": "", "FIELDNAM": "", "VAR_TYPE": kind, "FILLVAL": fill}
    if type != "char":
        out |= {"LABLAXIS": "", "SI_CONVERSION": " > ", "UNITS": " ", "VALIDMIN": "", "VALIDMAX": ""}
    if kind == "data":
        out |= {"DISPLAY_TYPE": "time_series" if dimensions == 1 else "spectrogram"}
    if not fixed and type != "tt2000":
        out["DEPEND_0"] = "Epoch"
    out |= {f"DEPEND_{k}": "" for k in range(1, dimensions)}
    if type == "tt2000":
        out |= {"UNITS": "ns", "MONOTON": "INCREASE", "TIME_BASE": "J2000", "TIME_SCALE": "Terrestrial Time", "REFERENCE_POSITION": "Rotating Earth Geoid"}
    return out


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the ``names`` that are no columns."""
    return [n for n in names if n not in df.columns]
