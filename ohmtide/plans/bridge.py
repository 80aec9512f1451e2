"""Analytic spectra over the driver's tables: inputs of known truth for queries, as Spark columns and as SQL for DuckDB.

A spectrum of 61 points from 1e5 to 1e-2 Hz for each row of `supplier`: a resistance, two RC processes and a series inductance, all
read off the key. Control spectra share the truth of their cell (four keys), and differ by 0.1 % a replicate and by an outlier.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = 61


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def truth(keys: DataFrame, k: str = "k") -> DataFrame:
    """Columns r0, r1, t1, r2, t2, l of the truth of key k."""
    c = F.col(k)
    return keys.withColumns({
        "r0": 0.8 + 0.1 * (c % 4), "r1": (1 + c % 5).cast("double"), "t1": 2e-4 * (1 + c % 3),
        "r2": 3 + 0.5 * (c % 7), "t2": 0.02 * (1 + c % 4), "l": 1e-6 * (c % 3),
    })


def _respond(rows: DataFrame, scale: float | F.Column = 1.0) -> DataFrame:
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    each = each.withColumn("frequency_hz", F.pow(F.lit(10.0), 5 - 7.0 * F.col("i") / (POINTS - 1))).withColumn("_w", F.lit(2 * math.pi) * F.col("frequency_hz"))
    x1, x2 = F.col("_w") * F.col("t1"), F.col("_w") * F.col("t2")
    re = F.col("r0") + F.col("r1") / (1 + x1 * x1) + F.col("r2") / (1 + x2 * x2)
    im = -F.col("_w") * F.col("l") + F.col("r1") * x1 / (1 + x1 * x1) + F.col("r2") * x2 / (1 + x2 * x2)
    return each.withColumns({"zreal": re * scale, "neg_zimag": im * scale})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, i, frequency_hz, zreal, neg_zimag."""
    keys = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return _respond(truth(keys)).select(F.col("k").alias("uid"), "i", "frequency_hz", "zreal", "neg_zimag")


def spectra(rows: DataFrame, *keep: str) -> DataFrame:
    """One row a spectrum: uid, points (in order of i) and what is kept."""
    point = F.struct("i", "frequency_hz", "zreal", "neg_zimag")
    own = F.sort_array(F.collect_list(point))
    return rows.groupBy("uid", *keep).agg(F.transform(own, lambda p: F.struct(p["frequency_hz"].alias("frequency_hz"), p["zreal"].alias("zreal"), p["neg_zimag"].alias("neg_zimag"))).alias("points"))


def control_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, cell, replicate, amplitude_mv, rest_time_s, basis, points."""
    k = F.col("k")
    keys = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).withColumns({
        "cell": F.floor(k / 4), "replicate": k % 4, "amplitude_mv": F.when(k % 2 == 0, 5.0).otherwise(10.0),
        "rest_time_s": F.when(k % 4 == 0, 60.0).when(k % 4 == 1, 600.0).otherwise(1800.0), "basis": F.lit("ohm"),
    })
    scale = (1 + 0.001 * F.col("replicate")) * F.when(F.col("k") % 11 == 0, 1.15).otherwise(1.0)
    rows = _respond(truth(keys, "cell"), scale).withColumn("uid", F.col("k"))
    return spectra(rows, "cell", "replicate", "amplitude_mv", "rest_time_s", "basis")


_Z = """
  SELECT {cols}, i, f AS frequency_hz, {s} * (r0 + r1 / (1 + (w * t1) * (w * t1)) + r2 / (1 + (w * t2) * (w * t2))) AS zreal,
    {s} * (-w * l + r1 * (w * t1) / (1 + (w * t1) * (w * t1)) + r2 * (w * t2) / (1 + (w * t2) * (w * t2))) AS neg_zimag FROM {of}"""
_TRUTH = """0.8e0 + 0.1e0 * ({c} % 4) AS r0, 1e0 + {c} % 5 AS r1, 2e-4 * (1 + {c} % 3) AS t1, 3e0 + 0.5e0 * ({c} % 7) AS r2, 0.02e0 * (1 + {c} % 4) AS t2, 1e-6 * ({c} % 3) AS l"""

#: CTE `p`: the points of points().
SQL = f"""
b_i AS (SELECT unnest(range({POINTS}))::INT AS i),
b_q AS (SELECT s_suppkey AS k, i, pow(10e0, 5 - 7e0 * i / {POINTS - 1}) AS f, 2 * pi() * pow(10e0, 5 - 7e0 * i / {POINTS - 1}) AS w, {_TRUTH.format(c="s_suppkey")} FROM supplier, b_i),
p AS ({_Z.format(cols="k AS uid", s="1e0", of="b_q")})"""

#: CTE `cp`: the points of control_spectra(), one row each.
CONTROL_SQL = f"""
c_i AS (SELECT unnest(range({POINTS}))::INT AS i),
c_k AS (SELECT s_suppkey AS k, s_suppkey // 4 AS cell, s_suppkey % 4 AS replicate, CASE WHEN s_suppkey % 2 = 0 THEN 5e0 ELSE 10e0 END AS amplitude_mv,
  CASE s_suppkey % 4 WHEN 0 THEN 60e0 WHEN 1 THEN 600e0 ELSE 1800e0 END AS rest_time_s, (1 + 0.001e0 * (s_suppkey % 4)) * CASE WHEN s_suppkey % 11 = 0 THEN 1.15e0 ELSE 1e0 END AS s FROM supplier),
c_q AS (SELECT *, pow(10e0, 5 - 7e0 * i / {POINTS - 1}) AS f, 2 * pi() * pow(10e0, 5 - 7e0 * i / {POINTS - 1}) AS w, {_TRUTH.format(c="cell")} FROM c_k, c_i),
cp AS ({_Z.format(cols="k AS uid, cell, replicate, amplitude_mv, rest_time_s", s="s", of="c_q")})"""
