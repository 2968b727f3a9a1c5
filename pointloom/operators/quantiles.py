"""Exact quantiles by refined histograms: a few counting passes, no sort, no buffer of distinct values."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointloom.functions.storage import discard, materialize

BINS = 1024


def exact_quantile(values: DataFrame, column: str, share: float, by: str | None = None, bins: int = BINS) -> dict:
    """The quantile of each group (key None without ``by``), linear between its neighbours, as ``percentile`` has it.

    Each pass counts the values of ``bins`` equal parts of a group's range, with their least and greatest,
    and goes on in the part that holds the rank. Both ends of a range fall into parts of their own, so ranges
    shrink until the rank's neighbours are known; a few hundred rows a group come to the driver in a pass.
    Nulls, NaN and infinities don't count, nor do rows of a null group; groups without values aren't listed.
    """
    spark = values.sparkSession
    group = F.col(by) if by else F.lit(0)
    v = values.select(group.alias("_g"), F.col(column).cast("double").alias("_v")).where("abs(_v) < DOUBLE('Infinity') AND _g IS NOT NULL")
    v = materialize(v, "values")
    kind, found, live = to_arrow_type(v.schema["_g"].dataType), {}, {}
    for g, n, lo, hi in v.groupBy("_g").agg(F.count("*"), F.min("_v"), F.max("_v")).collect():  # a row per group
        at = (n - 1) * share
        live[g] = (lo, hi, math.floor(at), at - math.floor(at))
    while live:
        for g in [g for g, (lo, hi, _, _) in live.items() if lo == hi]:
            found[g] = live.pop(g)[0]
        if not live:
            break
        state = spark.createDataFrame(pa.table([pa.array(list(live), kind), *(pa.array([x[i] for x in live.values()], pa.float64()) for i in (0, 1))], ["_g", "_lo", "_hi"]))
        part = f"CAST(least({bins - 1}, floor((_v / 2 - _lo / 2) / (_hi / 2 - _lo / 2) * {bins})) AS INT)"
        inside = v.join(F.broadcast(state), "_g").where("_v BETWEEN _lo AND _hi").withColumn("_part", F.expr(part))  # a row per group
        parts: dict = {}
        for g, _, n, lo, hi in sorted(inside.groupBy("_g", "_part").agg(F.count("*"), F.min("_v"), F.max("_v")).collect(), key=lambda r: r[1]):
            parts.setdefault(g, []).append((n, lo, hi))
        for g, own in parts.items():
            _, _, k, beyond = live[g]
            i, before = 0, 0
            while before + own[i][0] <= k:
                before += own[i][0]
                i += 1
            n, lo, hi = own[i]
            if k + 1 == before + n:  # the last of its part: the next value is the first of another
                upper = own[i + 1][1] if beyond and i + 1 < len(own) else hi
                found[g] = (1 - beyond) * hi + beyond * upper
                del live[g]
            else:
                live[g] = (lo, hi, k - before, beyond)
    discard(v)
    return found if by else {None: found[0]} if found else {}
