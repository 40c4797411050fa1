"""Checks of metadata over a catalogue of variables that is made from the parts: each part is a variable with attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import rules as R
from tideframe.plans.registry import Registry, table

query = Registry()

_ATTRS = {
    "TYPE": "case k % 3 when 0 then 'double' when 1 then 'int' else 'float' end",
    "FILLVAL": "case when k % 5 = 0 then null when k % 7 = 0 then '-999' when k % 3 = 1 then '-2147483648' else '-1.0E31' end",
    "VALIDMIN": "concat(s, '')",
    "VALIDMAX": "case when k % 2 = 0 then '30' else '99.5' end",
    "SCALEMIN": "concat(k % 60, '')",
    "SCALEMAX": "'45'",
    "FIELDNAM": "case when k % 11 = 0 then 'other' else concat('v', k) end",
    "UNITS": "case k % 4 when 0 then '' when 1 then 'nT' when 2 then 'km' else 'nT' end",
    "DEPEND_0": "case when k % 10 = 0 then null when k % 17 = 0 then concat('w', k) else concat('v', k - k % 10) end",
    "DELTA_PLUS_VAR": "case when k % 10 = 3 then concat('v', k + 1) when k % 10 = 4 then concat('x', k) end",
    "SHAPE": "case k % 10 when 5 then '12' when 6 then '12, 3' when 7 then '12,3' when 8 then case when k % 20 = 8 then '12,3' else '12,4' end when 9 then '7' else '' end",
    "RECORDS": "case when k % 13 = 0 then '90' else '100' end",
    "DEPEND_1": "case k % 10 when 6 then concat('v', k - 1) when 7 then concat('v', k - 2) when 8 then concat('v', k - 3) when 9 then concat('v', k - 4) end",
    "DEPEND_2": "case k % 10 when 8 then concat('v', k - 1) when 6 then concat('v', k - 1) end",
    "DISPLAY_TYPE": "case when k % 6 = 0 then 'spectrogram' else 'time_series' end",
}
_CATALOGUE = "select * from (" + " union all ".join(f"select concat('v', k) as variable, '{a}' as attr, {v} as value from p" for a, v in _ATTRS.items()) + ") q where value is not null"
_WITH = f"with p as (select p_partkey k, p_size s from part), c as ({_CATALOGUE})"


def _of(attr: str, name: str = "") -> str:
    return f"(select variable, value {name or attr.lower()} from c where attr = '{attr}')"


def _catalogue(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return spark.sql(_CATALOGUE.replace(" from p", " from {parts}"), parts=parts)


_REFERENCES = "'^(DEPEND|LABL_PTR)_[0-9]+$|^DELTA_(PLUS|MINUS)_VAR$'"
_SQL = {
    "missing_references": f"select variable, 'depends' as rule, attr || ' variable ' || value || ' missing' message from c where regexp_matches(attr, {_REFERENCES}) and value not in (select variable from c)",
    "empty_entries": "select variable, 'empty_entry' as rule, 'empty attribute ' || attr message from c where value = ''",
    "wrong_fill": f"""select t.variable, 'fillval' as rule, case when f.fillval is null then 'no FILLVAL' else 'FILLVAL ' || f.fillval || ' should be ' || case t.type when 'int' then '-2147483648' else '-1e+31' end end message
 from {_of('TYPE')} t left join {_of('FILLVAL')} f using (variable) where f.fillval is null or f.fillval = '-999'""",
    "wrong_limits": f"""select variable, 'validrange' as rule, 'VALIDMIN > VALIDMAX' message from {_of('VALIDMIN', 'a')} join {_of('VALIDMAX', 'b')} using (variable) where a::double > b::double
 union all select variable, 'scalerange', 'SCALEMIN > SCALEMAX' from {_of('SCALEMIN', 'a')} join {_of('SCALEMAX', 'b')} using (variable) where a::double > b::double""",
    "wrong_names": "select variable, 'fieldnam' as rule, 'FIELDNAM ' || value message from c where attr = 'FIELDNAM' and value <> variable",
    "wrong_deltas": """select r.variable, 'deltas' as rule, 'DELTA_PLUS_VAR ' || r.value || ' differs in ' || a.attr message from c r join c a on a.variable = r.variable and a.attr in ('TYPE', 'UNITS', 'SHAPE', 'RECORDS')
 join c b on b.variable = r.value and b.attr = a.attr where r.attr = 'DELTA_PLUS_VAR' and a.value <> b.value""",
    "wrong_record_count": f"""select r.variable, 'recordcount' as rule, a.n || ' records but ' || b.n || ' of ' || r.value message from c r join {_of('RECORDS', 'n')} a on a.variable = r.variable join {_of('RECORDS', 'n')} b on b.variable = r.value
 where r.attr = 'DEPEND_0' and a.n <> b.n""",
    "wrong_sizes": """, sh as (select variable, list_transform(list_filter(string_split(value, ','), lambda x: trim(x) <> ''), lambda x: trim(x)::int) shape from c where attr = 'SHAPE'),
 r as (select c.variable, substr(c.attr, 8, 1)::int k, c.value as other, o.shape there, m.shape[substr(c.attr, 8, 1)::int] own, (select u.shape[1] from c d join sh u on u.variable = d.value where d.variable = c.value and d.attr = 'DEPEND_1') under
  from c join sh o on o.variable = c.value join sh m on m.variable = c.variable where regexp_matches(c.attr, '^DEPEND_[1-9]$')),
 l as (select *, case when under is null or list_position(there, under) is null or list_position(there, under) = 0 then there else there[:list_position(there, under) - 1] || there[list_position(there, under) + 1:] end rest from r),
 e as (select variable, case when len(rest) <> 1 then 'dimension ' || k || ' depends on more than one of ' || other when own <> rest[1] then 'dimension ' || k || ' has ' || own || ' but ' || other || ' ' || rest[1] end message from l)
 select variable, 'depsize' as rule, message from e where message is not null""",
    "wrong_display": """select d.variable, 'validdisplaytype' as rule, case when s.value = '' then 'one value' else 'many values' end || ' a record shown as ' || d.value message from c d join c s on s.variable = d.variable and s.attr = 'SHAPE'
 where d.attr = 'DISPLAY_TYPE' and d.value <> case when s.value = '' then 'time_series' else 'spectrogram' end""",
}


def _checked(check):
    def run(spark, sf_dir):
        return check(_catalogue(spark, sf_dir))

    return run


for _name, _text in _SQL.items():
    _run = _checked(getattr(R, _name))
    _run.__name__ = f"rule_{_name}"
    query(_WITH + _text)(_run)


@query(_WITH + f"select distinct variable from c where variable not in (select value from c where regexp_matches(attr, {_REFERENCES}))")
def main_variables(spark, sf_dir):
    return R.main_variables(_catalogue(spark, sf_dir))


@query(_WITH + ", " + ", ".join(f"m{k} as ({('with ' + t[2:] if t.startswith(', ') else t)})" for k, t in enumerate(_SQL.values())) + " select rule, count(*)::bigint n, count(distinct variable)::bigint as variables from (" + " union all ".join(f"select variable, rule, message from m{k}" for k in range(len(_SQL))) + ") group by rule")
def all_rules(spark, sf_dir):
    """How many messages each rule gives over the whole catalogue, and for how many variables."""
    return R.all_checks(_catalogue(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("variable").alias("variables"))


_FILES = "select 'data/' || case when o_orderkey % 7 = 0 then 'other' else 'mission' end || '_' || o_orderkey || '_v1.cdf' path, case when o_orderkey % 5 = 0 then null else 'mission' end logical_source, case when o_orderkey % 3 = 0 then null when o_orderkey % 11 = 0 then 'mission_0_v1' else 'mission_' || o_orderkey || '_v1' end logical_file_id from orders"


@query(f"""with f as ({_FILES}), n as (select *, regexp_extract(path, '[^/]*$') as name, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') stem from f)
select path, 'no Logical_source' message from n where logical_source is null union all select path, 'Logical_source isn''t the start of ' || name from n where not starts_with(name, logical_source)
union all select path, 'no Logical_file_id' from n where logical_file_id is null union all select path, 'Logical_file_id isn''t the stem of ' || name from n where stem <> logical_file_id""")
def rule_file_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return R.wrong_file_names(spark.sql(_FILES.replace("from orders", "from {orders}"), orders=orders))


@query("select event_id, case when value > 400 then -1e31 else round(value, 6) end as value from events")
def filled_values(spark, sf_dir):
    """Values that were made null are written as the fill value."""
    x = R.replace_invalid(F.col("value"), None, None, 400)
    return table(spark, sf_dir, "events").select("event_id", R.fill_invalid(F.round(x, 6), R.FILL["double"]).alias("value"))


@query("""with p as (select p_partkey k, p_size s, ['byte', 'short', 'int', 'bigint', 'double', 'string'][p_partkey % 6 + 1] as type from part),
q as (select *, case when k % 4 = 0 then null else (k % 50) - 20 end::double low, case when k % 4 = 0 then null else (k % 50) - 20 + s * s end::double high from p)
select 'v' || k as variable, type, case type when 'byte' then '-128' when 'short' then '-32768' when 'int' then '-2147483648' when 'bigint' then '-9223372036854775808' when 'string' then ' ' else '-1e+31' end fill,
 case when type = 'string' then 'A12' when type = 'double' then case when low is null or high - low > 1000 then 'G10.2E3' else 'F' || (greatest(length(high::int::varchar), length(low::int::varchar)) + 1 + d) || '.' || d end
  when low is null then case type when 'byte' then 'I4' when 'short' then 'I6' when 'int' then 'I11' else 'I20' end
  when low < 0 then 'I' || (floor(log10(greatest(abs(low), abs(high), 1)))::int + 2) else 'I' || (case when high = 0 then 1 else floor(log10(high))::int end + 1) end format
from (select *, case when high - low <= 11 then 3 when high - low <= 101 then 2 else 1 end d from q)""")
def standard_attributes(spark, sf_dir):
    """Standard fill values, and formats by type and limits."""
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.get(F.array(*map(F.lit, ("byte", "short", "int", "bigint", "double", "string"))), (k % 6).cast("int"))
    low = F.when(k % 4 != 0, k % 50 - 20).cast("double")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), k.cast("string")).alias("variable"), kind.alias("type"), low.alias("low"), (low + s * s).alias("high"))
    return rows.select("variable", "type", R.standard_fill(F.col("type")).alias("fill"), R.standard_format(F.col("type"), F.lit(12), F.col("low"), F.col("high")).alias("format"))


@query(f"""{_WITH} select r.variable, r.attr, r.value as other, coalesce(t.value, '') as type, coalesce(s.value, '') as shape from c r join (select distinct variable from c) o on o.variable = r.value
left join c t on t.variable = r.value and t.attr = 'TYPE' left join c s on s.variable = r.value and s.attr = 'SHAPE' where regexp_matches(r.attr, '^DELTA_(PLUS|MINUS)_VAR$')""")
def delta_variables(spark, sf_dir):
    """The uncertainties of each variable beside their type and shape."""
    return R.deltas(_catalogue(spark, sf_dir)).select("variable", "attr", "other", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("shape", F.lit("")).alias("shape"))
