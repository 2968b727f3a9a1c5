"""Point-cloud shaped views over the driver's tables, as DataFrames and as DuckDB CTEs.

``events`` gives an encoder series (views) and scan frames (the rest), ``embeddings`` clouds of 21 points a
vector, ``lineitem`` one large cloud.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geometry import TWO_PI


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t_ns")


def encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select("event_id", _ns(), F.pmod("value", F.lit(TWO_PI)).alias("angle"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id", _ns())


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("p"))
    return e.select("vec_id", "label", "p", *(F.col("embedding")[F.col("p") * 3 + i].alias(n) for i, n in enumerate("xyz")))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of frames: ten times the size, a quarter of a second apart."""
    p = points(spark, sf_dir)
    p = p.select(F.col("vec_id").alias("frame_id"), F.col("p").alias("pt_idx"), *((F.col(n).cast("double") * 10).alias(n) for n in "xyz"), (F.col("p") * 0.25).alias("time"))
    f = frames(spark, sf_dir).select(F.col("event_id").alias("frame_id"), F.col("t_ns").alias("stamp_ns"))
    return p.join(f, "frame_id")


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 997).alias("y"), (F.col("l_discount") * 100).alias("z"))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", _ns(), F.col("value").alias("ax"), (F.col("event_id") % 7).cast("double").alias("ay"), (F.col("user_id") % 5).cast("double").alias("az"))


TP = "6.283185307179586"
ENC = f"""
enc AS (SELECT event_id, epoch_us(ts) * 1000 AS t_ns, value % {TP} AS angle FROM events WHERE event_type = 'view'),
enc1 AS (SELECT *, angle - lag(angle) OVER (ORDER BY t_ns, event_id) AS s FROM enc),
enc2 AS (SELECT *, CASE WHEN (s + pi()) % {TP} < 0 THEN (s + pi()) % {TP} + {TP} ELSE (s + pi()) % {TP} END - pi() AS w FROM enc1),
enc3 AS (SELECT event_id, t_ns, angle, CASE WHEN s IS NULL OR abs(s) < pi() THEN 0.0 WHEN w = -pi() AND s > 0 THEN pi() - s ELSE w - s END AS fix FROM enc2),
uenc AS (SELECT event_id, t_ns, angle + sum(fix) OVER (ORDER BY t_ns, event_id) AS angle FROM enc3),
seg AS (SELECT * FROM (SELECT lag(t_ns) OVER o AS a, lag(angle) OVER o AS va, t_ns AS z, angle AS vz FROM uenc
        WINDOW o AS (ORDER BY t_ns, event_id)) WHERE a < z),
ends AS (SELECT (SELECT min(t_ns) FROM uenc) AS t0, (SELECT max(t_ns) FROM uenc) AS t1,
         (SELECT angle FROM uenc ORDER BY t_ns, event_id DESC LIMIT 1) AS v0,
         (SELECT angle FROM uenc ORDER BY t_ns DESC, event_id DESC LIMIT 1) AS v1)"""
FRAMES = "frames AS (SELECT event_id, epoch_us(ts) * 1000 AS t_ns FROM events WHERE event_type <> 'view')"
PTS = "pts AS (SELECT vec_id, label, CAST(p AS INT) AS p, embedding[3*p+1] AS x, embedding[3*p+2] AS y, embedding[3*p+3] AS z FROM embeddings, range(21) r(p))"
SCAN = f"""{FRAMES}, {PTS},
scan AS (SELECT vec_id AS frame_id, p AS pt_idx, CAST(x AS DOUBLE)*10 AS x, CAST(y AS DOUBLE)*10 AS y, CAST(z AS DOUBLE)*10 AS z,
         t_ns AS stamp_ns, t_ns + CAST(p AS BIGINT) * 250000000 AS t FROM pts JOIN frames ON event_id = vec_id)"""
BIG = "big AS (SELECT l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, l_quantity AS x, l_extendedprice / 997 AS y, l_discount * 100 AS z FROM lineitem)"
IMU = "imu AS (SELECT event_id, epoch_us(ts) * 1000 AS t_ns, value AS ax, CAST(event_id % 7 AS DOUBLE) AS ay, CAST(user_id % 5 AS DOUBLE) AS az FROM events)"


def theta(q: str) -> str:
    """CTE ``th``: the rows of ``q`` (with time t) and the interpolated angle."""
    return f"""th AS (SELECT q.*, CASE WHEN q.t >= t1 THEN v1 WHEN q.t <= t0 THEN v0 ELSE va + (q.t - a) / (z_ - a) * (vz - va) END AS theta
      FROM {q} q CROSS JOIN ends LEFT JOIN (SELECT a, va, z AS z_, vz FROM seg) s ON q.t >= a AND q.t < z_ AND q.t > t0 AND q.t < t1)"""


DESKEWED = """loc AS (SELECT *, cos(radians(-1.6)) * x - sin(radians(-1.6)) * y AS lx, sin(radians(-1.6)) * x + cos(radians(-1.6)) * y AS ly, z + 0.0108 AS lz FROM th),
trn AS (SELECT *, lx AS tx, ly * cos(-theta) - lz * sin(-theta) AS ty, ly * sin(-theta) + lz * cos(-theta) - 0.0108 AS tz FROM loc),
dsk AS (SELECT frame_id, pt_idx, cos(radians(-1.6)) * tx + sin(radians(-1.6)) * ty AS x, -sin(radians(-1.6)) * tx + cos(radians(-1.6)) * ty AS y, tz AS z FROM trn)"""
