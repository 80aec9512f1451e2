"""Operators on sequences (by, order, value): sweeps, steps of time, counts of quality, correlations, curves and their peaks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


def sweep_runs(points: DataFrame, by: str, order: str, frequency: str) -> DataFrame:
    """All columns and run (from 1): a new run begins where frequency goes back by more than 20 % against the sweep's direction,
    which is the sign of the median of the steps of log10 f. Equal frequencies make one run."""
    w = Window.partitionBy(by).orderBy(order)
    p = points.withColumn("_step", F.log10(frequency) - F.log10(F.lag(frequency).over(w)))
    falls = F.median(F.when(F.abs("_step") > 1e-12, F.col("_step"))).over(Window.partitionBy(by)) < 0
    before = F.lag(frequency).over(w)
    cut = F.when(falls, F.col(frequency) > before * 1.2).when(~falls, F.col(frequency) < before / 1.2).otherwise(F.lit(False))
    return p.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("run", 1 + F.sum("_cut").over(w)).drop("_step", "_cut")


def time_steps(rows: DataFrame, by: str, order: str, time: str) -> DataFrame:
    """(by, order, step, reference, anomalous) for each row after the first: a step is anomalous if it is not positive, or more
    than three times the median of the positive steps among the three before and the three after it."""
    w = Window.partitionBy(by).orderBy(order)
    steps = rows.where(F.col(time).isNotNull()).withColumn("step", F.col(time) - F.lag(time).over(w)).where("step IS NOT NULL")
    near = lambda a, b: F.filter(F.collect_list("step").over(w.rowsBetween(a, b)), lambda x: x > 0)
    ordered = F.array_sort(F.concat(near(-3, -1), near(1, 3)))
    n = F.size(ordered)
    median = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
    s = steps.withColumn("reference", median)
    return s.select(by, order, "step", "reference", ((F.col("step") <= 0) | F.coalesce(F.col("step") > 3 * F.col("reference"), F.lit(False))).alias("anomalous"))


def time_summary(rows: DataFrame, by: str, order: str, time: str, shown: int = 20) -> DataFrame:
    """(by, start, end, duration, median_step, least_step, largest_step, increasing, anomalies, first_anomalies) of each sequence with
    a time; the median is of positive steps, and first_anomalies has (order, step, reference) of the first that time_steps() marks. All
    about steps is null, and anomalies 0, where there is one time only."""
    timed = rows.where(F.col(time).isNotNull())
    whole = timed.groupBy(by).agg(F.min_by(time, order).alias("start"), F.max_by(time, order).alias("end"), (F.max(time) - F.min(time)).alias("duration"))
    one = F.when(F.col("anomalous"), F.struct(F.col(order).alias("order"), "step", "reference"))
    steps = time_steps(rows, by, order, time).groupBy(by).agg(
        F.median(F.when(F.col("step") > 0, F.col("step"))).alias("median_step"), F.min("step").alias("least_step"), F.max("step").alias("largest_step"), F.every(F.col("step") > 0).alias("increasing"),
        F.count_if("anomalous").alias("anomalies"), F.slice(F.sort_array(F.collect_list(one)), 1, shown).alias("first_anomalies"),
    )
    return whole.join(steps, by, "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))


def quality_counts(points: DataFrame, by: str, order: str, frequency: str, index: str) -> DataFrame:
    """by, points, duplicate_frequencies, direction_changes, index_gaps, status (suspect where any change or gap)."""
    w = Window.partitionBy(by).orderBy(order)
    p = points.withColumns({"_d": F.signum(F.col(frequency) - F.lag(frequency).over(w)), "_g": F.col(index) - F.lag(index).over(w)}).withColumn("_e", F.lag("_d").over(w))
    s = p.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"), (F.count(frequency) - F.count_distinct(frequency)).alias("duplicate_frequencies"),
        F.count_if(F.col("_d") != F.col("_e")).alias("direction_changes"), F.count_if(F.col("_g") > 1.000001).alias("index_gaps"),
    )
    return s.withColumn("status", F.when((F.col("direction_changes") > 0) | (F.col("index_gaps") > 0), "suspect").otherwise("pass"))


def lag1(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, lag1: correlation of a sequence with itself one step later; null for under four values or no spread in either part."""
    w = Window.partitionBy(by).orderBy(order)
    p = rows.withColumn("_next", F.lead(value).over(w))
    s = p.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr(value, "_next").alias("c"), F.stddev_pop(F.when(F.col("_next").isNotNull(), F.col(value))).alias("a"), F.stddev_pop("_next").alias("b"))
    return s.select(by, F.when((F.col("n") >= 4) & (F.col("a") > 0) & (F.col("b") > 0), F.col("c")).alias("lag1"))


def _trapezoid(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x)
    return curve.withColumn("_part", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).groupBy(*by).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("area"))


def gamma_area(curve: DataFrame, by: str, tau: str, gamma: str) -> DataFrame:
    """by, area: the integral of gamma over ln tau, by trapezoids, not under 0."""
    return _trapezoid(curve.withColumn("_x", F.log(tau)), [by], "_x", gamma).withColumn("area", F.greatest("area", F.lit(0.0)))


def clipped_area(curve: DataFrame, by: str, tau: str, gamma: str, low: str, high: str) -> DataFrame:
    """by, area: gamma_area() between the columns low and high, with gamma interpolated at ends that lie between points."""
    w = Window.partitionBy(by).orderBy(tau)
    p = curve.withColumns({"_x": F.log(tau), "_lo": F.log(low), "_hi": F.log(high)}).withColumns({"_x0": F.lag("_x").over(w), "_y0": F.lag(gamma).over(w)})
    a, b = F.greatest("_x0", "_lo"), F.least("_x", "_hi")
    at = lambda x: F.col("_y0") + (F.col(gamma) - F.col("_y0")) * (x - F.col("_x0")) / (F.col("_x") - F.col("_x0"))
    part = F.when((b > a) & (F.col("_x") > F.col("_x0")), (b - a) * (at(a) + at(b)) / 2).otherwise(0.0)
    return p.groupBy(by).agg(F.greatest(F.sum(part), F.lit(0.0)).alias("area"))


def peak_basins(curve: DataFrame, by: str, tau: str, gamma: str) -> DataFrame:
    """by, peak (from 0, by tau), index, tau_s, gamma, relative_height, area, basin_tau_min_s, basin_tau_max_s.

    A maximum is higher than the point before and not lower than the one after; an end counts if higher than its neighbour. Basins
    meet at the lowest point between two maxima (the first of equals), which belongs to both. Curves of under three points have none.
    """
    w = Window.partitionBy(by).orderBy(tau)
    rank = F.row_number().over(w) - 1
    before, after = F.lag(gamma).over(w), F.lead(gamma).over(w)
    top = F.when(before.isNull(), F.col(gamma) > after).when(after.isNull(), F.col(gamma) > before).otherwise((F.col(gamma) > before) & (F.col(gamma) >= after))
    p = curve.withColumns({"index": rank, "_top": top, "_n": F.count(F.lit(1)).over(Window.partitionBy(by))}).where("_n >= 3")
    # Points from a maximum up to the next (that included) share a gap; gap 0 lies before the first.
    p = p.withColumn("_gap", F.sum(F.col("_top").cast("int")).over(w))
    lowest = p.unionByName(p.where("_top").withColumn("_gap", F.col("_gap") - 1)).groupBy(by, "_gap").agg(F.min(F.struct(F.col(gamma), F.col("index"), F.col(tau).alias("t")))["index"].alias("cut"), F.max("_n").alias("_n"))
    tops = p.where("_top").select(by, F.col("_gap").alias("k"), "index", F.col(tau).alias("tau_s"), F.col(gamma).alias("gamma"), "_n")
    wt = Window.partitionBy(by)
    tops = tops.withColumns({"peaks": F.max("k").over(wt), "relative_height": F.col("gamma") / F.greatest(F.max("gamma").over(wt), F.lit(TINY))})
    left = lowest.select(by, (F.col("_gap") + 1).alias("k"), F.col("cut").alias("left_cut"))
    right = lowest.select(by, F.col("_gap").alias("k"), F.col("cut").alias("right_cut"))
    tops = tops.join(left, [by, "k"], "left").join(right, [by, "k"], "left")
    lo = F.when(F.col("k") == 1, 0).otherwise(F.col("left_cut"))
    hi = F.when(F.col("k") == F.col("peaks"), F.col("_n") - 1).otherwise(F.col("right_cut"))
    tops = tops.withColumns({"lo": lo, "hi": hi}).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.least(F.col("lo") + 1, F.col("_n") - 1)).otherwise(F.col("hi")))
    inside = p.select(by, F.col("index").alias("j"), F.col(tau).alias("t"), F.col(gamma).alias("g"))
    own = tops.select(by, "k", "lo", "hi").join(inside, by).where("j BETWEEN lo AND hi").withColumn("_x", F.log("t"))
    areas = _trapezoid(own, [by, "k"], "_x", "g")
    ends = own.groupBy(by, "k").agg(F.min("t").alias("basin_tau_min_s"), F.max("t").alias("basin_tau_max_s"))
    found = tops.join(areas, [by, "k"]).join(ends, [by, "k"])
    return found.select(by, (F.col("k") - 1).alias("peak"), "index", "tau_s", "gamma", "relative_height", F.greatest("area", F.lit(0.0)).alias("area"), "basin_tau_min_s", "basin_tau_max_s")


def peak_support(peaks: DataFrame, curve: DataFrame, by: str, tau: str, gamma: str, fmin: str = "fmin", fmax: str = "fmax") -> DataFrame:
    """Peaks with what of their basin lies in the measured window: in_window_area, area_impedance (null if the maximum is outside),
    area_supported, basin_window_fraction. The curve has fmin and fmax."""
    extent = curve.groupBy(by).agg(F.max(fmin).alias("fmin"), F.max(fmax).alias("fmax"))
    p = peaks.join(extent, by).withColumns({"win_lo": 1 / (2 * math.pi * F.col("fmax")), "win_hi": 1 / (2 * math.pi * F.col("fmin"))})
    p = p.withColumns({"lo": F.greatest("basin_tau_min_s", "win_lo"), "hi": F.least("basin_tau_max_s", "win_hi")})
    keyed = p.select(by, "peak", "lo", "hi").join(curve.select(by, tau, gamma), by).withColumn("_key", F.concat_ws("\x1f", by, "peak"))
    areas = clipped_area(keyed, "_key", tau, gamma, "lo", "hi").withColumnRenamed("area", "in_window_area")
    p = p.withColumn("_key", F.concat_ws("\x1f", by, "peak")).join(areas, "_key")
    f = 1 / (2 * math.pi * F.col("tau_s"))
    spans = F.log(F.col("hi") / F.col("lo")), F.greatest(F.log(F.col("basin_tau_max_s") / F.col("basin_tau_min_s")), F.lit(TINY))
    return p.select(
        *peaks.columns, "in_window_area", F.when(f.between(F.col("fmin"), F.col("fmax")), F.col("in_window_area")).alias("area_impedance"),
        ((F.col("basin_tau_min_s") >= F.col("win_lo")) & (F.col("basin_tau_max_s") <= F.col("win_hi"))).alias("area_supported"),
        F.when(F.col("hi") > F.col("lo"), F.least(spans[0] / spans[1], F.lit(1.0))).otherwise(0.0).alias("basin_window_fraction"),
    )


def signed_peaks(curve: DataFrame, by: str, tau: str, gamma: str, least: float = 0.03) -> DataFrame:
    """by, branch (RC-positive or RL-negative), tau_s, gamma: inner extrema of either sign with at least 3 % of its largest value."""
    w = Window.partitionBy(by).orderBy(tau)
    p = curve.select(by, F.col(tau).alias("tau_s"), F.col(gamma).alias("gamma"), F.lag(gamma).over(w).alias("b"), F.lead(gamma).over(w).alias("a"))
    both = p.select("*", F.explode(F.array(F.struct(F.lit("RC-positive").alias("branch"), F.lit(1.0).alias("s")), F.struct(F.lit("RL-negative").alias("branch"), F.lit(-1.0).alias("s")))).alias("side")).select("*", "side.*")
    v = lambda c: F.col(c) * F.col("s")
    both = both.withColumn("top", F.max(v("gamma")).over(Window.partitionBy(by, "branch")))
    keep = (F.col("top") > 0) & (v("gamma") >= least * F.col("top")) & (v("gamma") >= v("b")) & (v("gamma") > v("a"))
    return both.where(keep).select(by, "branch", "tau_s", "gamma")


def even_sample(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Rows at evenly spaced ranks, ends included, of sequences longer than `most`: the ranks rint(linspace(0, n-1, most))."""
    p = rows.withColumns({"_r": F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(by))})
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.rint(j * (F.col("_n") - 1) / F.lit(most - 1)).cast("int"))
    return p.where((F.col("_n") <= most) | F.array_contains(chosen, F.col("_r").cast("int"))).drop("_r", "_n")

