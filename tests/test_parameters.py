"""Parameter files, lists of leap seconds, and all derived quantities of a table."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tideframe.functions import plasma as P
from tideframe.functions import timescales as T
from tideframe.sources import text as X

PARAMETERS = "a remark\n\n#STARTTIME\n2014\tiYear\n4\n10\n1\n2\n3\n0.25\n\n#STOP\n100  MaxIteration\n5400.5 seconds\n#BEGIN_COMP IM ---\r\n#SATELLITE\n 2  n \nsat.dat\n\nno argument\n#FLAG\n#END_COMP IM\n#STOP\n-1\n1.8d3\n#ECHO\nT"


def test_parameter_files(spark, tmp_path):
    (tmp_path / "a.in").write_bytes(PARAMETERS.encode())
    (tmp_path / "b.in").write_text("#STOP\nmany\n#STARTTIME\n2014\n13\n1\n0\n0\n0\n0\n")
    (tmp_path / "c.in").write_text("")
    found = X.read_parameters(spark, str(tmp_path)).where(F.col("path").endswith("a.in"))
    rows = [tuple(r)[1:2] + tuple(r)[3:] for r in found.orderBy("position", "argument").collect()]
    start = [(None, "STARTTIME", k, v) for k, v in enumerate(["2014\tiYear", "4", "10", "1", "2", "3", "0.25"])]
    stop = [(None, "STOP", 0, "100  MaxIteration"), (None, "STOP", 1, "5400.5 seconds")]
    im = [("IM", "SATELLITE", 0, "2  n"), ("IM", "SATELLITE", 1, "sat.dat"), ("IM", "FLAG", None, None)]
    assert rows == start + stop + im + [(None, "STOP", 0, "-1"), (None, "STOP", 1, "1.8d3"), (None, "ECHO", 0, "T")]
    times = {r["path"][-4:]: tuple(r)[1:] for r in X.run_times(X.read_parameters(spark, str(tmp_path))).collect()}
    first = dt.datetime(2014, 4, 10, 1, 2, 3, 250000)
    assert times == {"a.in": (first, -1, 1800.0, first + dt.timedelta(minutes=30)), "b.in": (None, None, None, None)}


def test_lists_of_leap_seconds(spark):
    day = dt.datetime
    rows = [
        (day(2017, 12, 31), day(2017, 1, 15), day(2017, 1, 1), True),
        (day(2018, 1, 1), day(2017, 1, 15), day(2017, 1, 1), False),
        (day(2018, 6, 30), day(2017, 7, 1), day(2017, 1, 1), True),
        (day(2018, 7, 1), day(2017, 7, 1), day(2017, 1, 1), False),
        (day(2016, 12, 31), day(2014, 3, 1), day(2015, 7, 1), False),
        (day(2015, 12, 31), day(2014, 3, 1), day(2015, 7, 1), True),
        (day(2015, 12, 31), None, day(2015, 7, 1), None),
    ]
    df = spark.createDataFrame(rows, "now timestamp_ntz, read timestamp_ntz, last timestamp_ntz, want boolean")
    got = df.select(T.leaps_current(*map(F.col, ("now", "read", "last"))).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got[:-1]) and got[-1]["got"] is True  # what is null says nothing


def test_derived(spark):
    names = "bx by bz ux uy uz rho p oprho opux opuy opuz beta".split()
    rows = [(3.0, 0.0, 4.0, 0.0, 10.0, 0.0, 4.0, 2.0, 16.0, 3.0, 4.0, 0.0, 7.0), (0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 0.0, 1.0, None, None, None, None, None)]
    df = P.derived(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), "kev", ("op",), ("alfven",))
    assert df.columns == [*names, "b", "u", "ex", "ey", "ez", "uperp", "upar", "t", "opu", "opex", "opey", "opez", "opuperp", "opupar", "opalfven"]
    a, z = df.orderBy(F.desc("b")).collect()
    assert (a["b"], a["beta"], a["u"], a["upar"], a["uperp"], a["opu"]) == (5.0, 7.0, 10.0, 0.0, 10.0, 5.0)
    assert (a["ex"], a["ey"], a["ez"]) == (-0.04, 0.0, 0.03) and math.isclose(a["t"], 2.0 / 4.0 * 6.24150935)
    assert math.isclose(a["opalfven"], 5e-12 / math.sqrt(4e-7 * math.pi * 1.6726e-27 * 1e6 * 16))
    assert (z["b"], z["u"], z["t"], z["upar"], z["opalfven"]) == (0.0, 3.0, None, None, None)
    assert P.derived(df.select("rho")).columns == ["rho"]
