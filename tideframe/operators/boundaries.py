"""Boundaries of the plasmasphere from a series of the Kp index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.empirical import PLASMAPAUSE, PLASMAPAUSE_LT
from tideframe.operators.matching import interval_max

HOUR_US = 3_600_000_000


def plasmapause(ticks: DataFrame, index: DataFrame, ts: str, kp: str, key: str, model: str = "M2002", local_time: Column | None = None) -> DataFrame:
    """``ticks`` (key, ts, ...) with ``kp_max``, the largest Kp of the model's prior hours, and ``lpp``, the plasmapause in Earth radii.

    CA1992 looks back 24 hours, M2002 12, RT1970 none and takes the root. With ``local_time`` (an expression over the
    ticks, in hours) M2002 takes the coefficients of its sector; the other models know no local time. A tick without an
    index in its prior hours has nulls. ``key`` tells the ticks apart.
    """
    a, b, hours, power = PLASMAPAUSE[model]
    most = interval_max(ticks.select(key, ts), index, ts, kp, hours * HOUR_US, key).select(key, F.col(kp).alias("kp_max"))
    a, b = F.lit(a), F.lit(b)
    if local_time is not None and model == "M2002":
        sector = F.floor(F.pmod(local_time, F.lit(24))).cast("int")
        each = [(x, y) for n, x, y in PLASMAPAUSE_LT for _ in range(n)]
        a, b = (F.get(F.array(*(F.lit(e[k]) for e in each)), sector) for k in (0, 1))
    return ticks.join(most, key, "left").withColumn("lpp", a - b * F.pow("kp_max", F.lit(power)))
