"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohmtide.operators import screens
from ohmtide.plans import batch, bridge, inversions, readers, relational

QUERIES = relational.QUERIES | inversions.QUERIES | readers.QUERIES | batch.QUERIES
SQL = relational.SQL | inversions.SQL | readers.SQL | batch.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid with the verdicts of all screens of a spectrum."""
    points = bridge.points(spark, sf_dir)
    high = screens.high_frequency_inductance(points).select("uid", "n_high", "n_negative", "detected").withColumnRenamed("detected", "inductive")
    series = screens.series_inductance(points).select("uid", "inductance_h", "r_squared", "explainable")
    tail = screens.diffusion_tail(points).select("uid", "magnitude_slope", "detected").withColumnRenamed("detected", "diffusive")
    return high.join(series, "uid").join(tail, "uid")
