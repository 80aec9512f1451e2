"""Queries over whole-batch analysis: its tables, beside what the spectra are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.plans import analysis
from ohmtide.plans import bridge as B

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT s_suppkey AS uid, 'completed' AS status, 'screen-pass' AS kk_status, round(2e-4 * (1 + s_suppkey % 3), 6) AS tau_1, (1 + s_suppkey % 5)::DOUBLE AS ohm_1, round(0.02e0 * (1 + s_suppkey % 4), 6) AS tau_2, 3 + 0.5e0 * (s_suppkey % 7) AS ohm_2,
  round(0.8e0 + 0.1e0 * (s_suppkey % 4) + 1 + s_suppkey % 5 + 3 + 0.5e0 * (s_suppkey % 7), 1) AS total_ohm, 2::BIGINT AS major_peaks, 2::BIGINT AS persistent_peaks, {B.POINTS}::BIGINT AS reconstructed, {B.POINTS}::BIGINT AS recommended_points, {2 * B.POINTS}::BIGINT AS consistency_points FROM supplier""")
def batch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over all spectra: times and resistances from the rational model's poles, the whole resistance under the recommended curve,
    major peaks and those that persist under perturbation, and how many points the tables have."""
    points = B.points(spark, sf_dir)
    t = analysis.run(points, B.spectra(points))
    n = lambda name, column, where="true": t[name].where(where).groupBy("uid").agg(F.count(F.lit(1)).alias(column))
    poles = t["discrete"].where("kind = 'RC' AND resistance > 1e-3").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("tau_s", "resistance"))).alias("p"))
    pole = lambda i, field, digits, name: F.round(F.get("p", F.lit(i))[field], digits).alias(name)
    poles = poles.select("uid", pole(0, "tau_s", 6, "tau_1"), pole(0, "resistance", 4, "ohm_1"), pole(1, "tau_s", 6, "tau_2"), pole(1, "resistance", 4, "ohm_2"))
    curve = t["recommended_curves"].groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("tau_s", "gamma"))).alias("c"))
    strip = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: (b["gamma"] + a["gamma"]) / 2 * F.ln(b["tau_s"] / a["tau_s"]))
    curve = curve.select("uid", F.aggregate(strip, F.lit(0.0), lambda s, x: s + x).alias("area"))
    out = t["results"].select("uid", "status", "kk_status", "r_inf").join(curve, "uid", "left").join(poles, "uid", "left")
    counts = (("peaks", "major_peaks", "relative_height > 0.1"), ("evidence", "persistent_peaks", "sign_share >= 0.8 AND deletion_share >= 0.75"), ("reconstructions", "reconstructed"), ("recommended_fits", "recommended_points"), ("consistency", "consistency_points"))
    for c in counts:
        out = out.join(n(*c), "uid", "left")
    return out.withColumn("total_ohm", F.round(F.col("r_inf") + F.col("area"), 1)).drop("r_inf", "area")
