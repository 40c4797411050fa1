"""Time systems as column expressions over one canonical value: microseconds of naive UTC since 1970-01-01.

All functions take and return columns and stay in generated code; give those with a ladder of leap seconds a column that
exists, so that its expression is computed once. ``timestamp_ntz`` columns hold UTC. TAI counts SI
seconds since 1958-01-01 including leap seconds; "naive" systems ignore leap seconds.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Seconds from 1958-01-01 to 1970-01-01, from TAI's epoch to GPS's, and CDF milliseconds of 1958-01-01.
TAI_1970, GPS_TAI, CDF_1958_MS = 378_691_200, 694_656_019, 61_788_528_000_000
#: Days that begin with a new TAI - UTC of 1, 2, 3 ... seconds. Before mid-1972 whole seconds by convention.
LEAP_DAYS = (
    "1959-01-01", "1961-01-01", "1963-07-01", "1965-01-01", "1966-07-01", "1967-07-01", "1968-07-01", "1969-07-01", "1970-07-01", "1971-07-01",
    "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01", "1981-07-01",
    "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01", "1996-01-01",
    "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)
LEAP_US = tuple((date.fromisoformat(x) - date(1970, 1, 1)).days * DAY_US for x in LEAP_DAYS)


def utc_us(ts: Column) -> Column:
    """Naive microseconds since 1970-01-01 of a timestamp_ntz, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def from_utc_us(us: Column) -> Column:
    """timestamp_ntz of naive microseconds since 1970-01-01."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def leap_seconds(us: Column) -> Column:
    """TAI - UTC in whole seconds at a UTC instant; 0 before the first."""
    out = None
    for k in range(len(LEAP_US), 0, -1):  # recent times leave the ladder early
        out = F.when(us >= LEAP_US[k - 1], k) if out is None else out.when(us >= LEAP_US[k - 1], k)
    return out.otherwise(0).cast("long")


def tai_us(us: Column) -> Column:
    """TAI microseconds since 1958-01-01."""
    return us + (leap_seconds(us) + TAI_1970) * 1_000_000


def utc_us_of_tai(tai: Column) -> Column:
    """UTC of TAI microseconds; inside a leap second the last microsecond before it."""
    naive = tai - TAI_1970 * 1_000_000
    out = None
    for k in range(len(LEAP_US), 0, -1):
        start = LEAP_US[k - 1] + (k - 1) * 1_000_000  # the leap second, on the naive scale
        value = F.when(naive < start + 1_000_000, F.lit(LEAP_US[k - 1] - 1)).otherwise(naive - k * 1_000_000)
        out = F.when(naive >= start, value) if out is None else out.when(naive >= start, value)
    return out.otherwise(naive)


def unix_seconds(us: Column) -> Column:
    return us / 1e6


def gps_seconds(us: Column) -> Column:
    return tai_us(us) / 1e6 - GPS_TAI


def cdf_ms(us: Column) -> Column:
    """Milliseconds since year 0, naive."""
    return us / 1e3 + (CDF_1958_MS + TAI_1970 * 1000)


def tt2000_ns(us: Column) -> Column:
    """Nanoseconds of terrestrial time since J2000, leap seconds included."""
    j2000_tai_ms = (946_728_000 + TAI_1970) * 1000  # TAI reading of 2000-01-01T12:00:00 counted naively
    return (tai_us(us) - F.lit(j2000_tai_ms).cast("long") * 1000) * 1000 + 32_184_000_000


def tai_us_of_tt2000(ns: Column) -> Column:
    j2000_tai_ms = (946_728_000 + TAI_1970) * 1000
    since = ns - 32_184_000_000
    return F.call_function("div", since - F.pmod(since, F.lit(1000)), F.lit(1000)) + F.lit(j2000_tai_ms).cast("long") * 1000


def utc_us_of_tt2000(ns: Column) -> Column:
    return utc_us_of_tai(tai_us_of_tt2000(ns))


def epoch16(us: Column) -> Column:
    """struct(s, ps): whole seconds since year 0 and picoseconds."""
    seconds = F.floor(us / 1_000_000).cast("long")
    return F.struct((seconds + (CDF_1958_MS // 1000 + TAI_1970)).cast("double").alias("s"), ((us - seconds * 1_000_000) * 1_000_000).cast("double").alias("ps"))


def epoch16_to_ms(value: Column) -> Column:
    return value["s"] * 1000 + value["ps"] / 1e9


def utc_us_of_cdf_ms(ms: Column) -> Column:
    return F.round((ms - (CDF_1958_MS + TAI_1970 * 1000)) * 1000).cast("long")


def _noon_days(us: Column) -> Column:
    """Days since 1958-01-01T12:00; a noon-to-noon day with a leap second is stretched over 86401 seconds."""
    since = us + (TAI_1970 - 43200) * 1_000_000
    day = F.floor(since / DAY_US).cast("long")
    inside = since - day * DAY_US
    middle = (day + 1) * DAY_US - TAI_1970 * 1_000_000  # the midnight in it, as UTC
    leap = middle.isin(list(LEAP_US))
    late = F.when(inside >= DAY_US // 2, 1_000_000).otherwise(0)
    return day + F.when(leap, (inside + late) / 86401e6).otherwise(inside / 86400e6)


def julian_date(us: Column) -> Column:
    return _noon_days(us) + 2436205.0


def modified_julian_date(us: Column) -> Column:
    return _noon_days(us) + 36204.5


def ordinal_day(us: Column) -> Column:
    """Days since year 1, naive; ten days less before the Gregorian calendar."""
    day = us / 86400e6 + 719163.0
    return F.when(day < 577736, day - 10).otherwise(day)


def fractional_day_of_year(ts: Column) -> Column:
    """0-based day of the year with its fraction."""
    return F.dayofyear(ts) - 1 + F.pmod(utc_us(ts), F.lit(DAY_US)) / 86400e6


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def day_of_year_to_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def hms(seconds: Column) -> Column:
    """struct(h, m, s): rounded seconds of the day, wrapped."""
    s = F.pmod(F.round(seconds).cast("long"), F.lit(86400))
    return F.struct(F.floor(s / 3600).cast("int").alias("h"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int").alias("m"), F.pmod(s, F.lit(60)).cast("int").alias("s"))


#: Days of a rotation and microseconds of its epoch, by kind.
ROTATIONS = {"carrington": (27.2753, "1853-11-09 21:38:44.160000"), "bartels": (27.0, "1832-02-08 00:00:00")}


def solar_rotation(ts: Column, kind: str = "carrington", whole: bool = True) -> Column:
    """Number of the solar rotation, the first is 1."""
    days, epoch = ROTATIONS[kind]
    turns = F.timestamp_diff("MICROSECOND", F.lit(epoch).cast("timestamp_ntz"), ts) / (days * 86400e6) + 1
    return F.floor(turns).cast("long") if whole else turns


def rotation_start(number: Column, kind: str = "carrington") -> Column:
    """When a rotation begins."""
    days, epoch = ROTATIONS[kind]
    return F.timestamp_add("MICROSECOND", F.round((number - 1) * (days * 86400e6)).cast("long"), F.lit(epoch).cast("timestamp_ntz"))


def date_in_name(path: Column) -> Column:
    """The first valid yyyymmdd of 1950 to 2049 in a file's name; null if there is none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = F.regexp_extract(name, r"((?:19[5-9]|20[0-4])\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))", 1)
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyyMMdd")).cast("date")


def day_number(ms: Column) -> Column:
    """Days since 1970-01-01 of CDF milliseconds, as plots count them."""
    return (ms - (CDF_1958_MS + TAI_1970 * 1000)) / 86400e3


def leap_aware(text: Column) -> Column:
    """struct(iso, utc, offset_us) of a time in ISO order that may name a leap second.

    ``utc`` is the last time before or at it that a timestamp can hold, ``offset_us`` what is missing: a second where the
    text says 60 seconds. The ISO text keeps the 60.
    """
    said = r"^([^.]{8,}59[^0-9]?)60((?:[.][0-9]+)?)$"
    leap = text.rlike(said)
    utc = F.try_to_timestamp(F.regexp_replace(text, said, "$159$2")).cast("timestamp_ntz")
    shown = F.when(leap, F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:"), F.lit("60"))).otherwise(iso(utc))
    return F.struct(shown.alias("iso"), utc.alias("utc"), F.when(leap, 1_000_000).otherwise(0).alias("offset_us"))


def leaps_known_until(read: Column, last: Column) -> Column:
    """The day until which a list of leap seconds is complete, from the time it was published and its last leap.

    Leaps are announced half a year ahead and come at the ends of half years: a list holds until the half year after next
    of its publication, and none can come in the half year after its last leap. A null time says nothing.
    """
    half = lambda year, second: F.make_timestamp_ntz(year, F.when(second, 7).otherwise(1), *(F.lit(x) for x in (1, 0, 0, 0)))
    late, leap_late = F.month(read) > 6, F.month(last) > 6
    return F.greatest(half(F.year(read) + 1, late), half(F.year(last) + leap_late.cast("int"), ~leap_late))


def leaps_current(now: Column, read: Column, last: Column) -> Column:
    """Whether a list of leap seconds can be trusted at ``now``."""
    return now < leaps_known_until(read, last)
