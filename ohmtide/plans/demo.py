"""A deterministic batch of synthetic spectra: two directions, several voltages, a resistance and a time that vary with voltage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def demo(spark: SparkSession, voltages: int = 5, points: int = 61) -> DataFrame:
    """uid, direction, voltage_v, i, frequency_hz, zreal, neg_zimag: 1e5 to 1e-2 Hz, two RC processes and a series inductance."""
    nodes = spark.range(2 * voltages).select(F.col("id").alias("uid"), F.when(F.col("id") % 2 == 0, "charge").otherwise("discharge").alias("direction"), (3.4 + 0.2 * F.floor(F.col("id") / 2)).alias("voltage_v"))
    late = F.when(F.col("direction") == "discharge", 1.0).otherwise(0.0)
    each = nodes.withColumns({"r": 4.0 - 0.8 * (F.col("voltage_v") - 3.4) + 0.5 * late, "t": 0.05 * (1 + 0.5 * (F.col("voltage_v") - 3.4)) * (1 + 0.3 * late), "i": F.explode(F.sequence(F.lit(0), F.lit(points - 1)))})
    each = each.withColumn("frequency_hz", F.pow(F.lit(10.0), 5 - 7.0 * F.col("i") / (points - 1))).withColumn("w", 2 * math.pi * F.col("frequency_hz"))
    a, b = F.col("w") * 2e-4, F.col("w") * F.col("t")
    re = 1.2 + 1.8 / (1 + a * a) + F.col("r") / (1 + b * b)
    im = -2e-6 * F.col("w") + 1.8 * a / (1 + a * a) + F.col("r") * b / (1 + b * b)
    return each.select("uid", "direction", "voltage_v", "i", "frequency_hz", re.alias("zreal"), im.alias("neg_zimag"))
