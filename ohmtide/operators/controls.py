"""Control evidence: pairs of spectra of a group, group verdicts, evidence of each spectrum, final verdicts. Joins and aggregates.

Spectra are rows of (uid, basis, points: array<struct<frequency_hz, zreal, neg_zimag>>) with a group column for each purpose; a
control group holds the repeats of one measurement, so its pairs are few. A pair's own points are compared inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmtide.numerics.curves import repeat_peaks

# --- fixed values: status words --------------------------------------------------------------------------------------------
ADVERSE = ("repeat-disagreement", "repeat-peak-disagreement", "repeat-outlier-detected", "amplitude-dependent", "rest-dependent")
SUPPORTED = ("repeat-supported", "linearity-supported", "rest-stable")
# ---------------------------------------------------------------------------------------------------------------------------
WARN_PERCENT = 2.0
TOLERANCE = 1e-5
TINY = 2.2250738585072014e-308
POINT = "struct<frequency_hz:double,zreal:double,neg_zimag:double>"


def _greedy(first: Column, second: Column, tolerance: float) -> Column:
    def take(state: Column, a: Column) -> Column:
        distance = F.transform(second, lambda b, j: F.struct(F.abs(F.log10(b["frequency_hz"] / a["frequency_hz"])).alias("d"), j.alias("j")))
        near = F.array_min(distance)
        fits = (near["d"] <= tolerance) & ~F.array_contains(state["used"], near["j"])
        pair = F.struct(a.alias("a"), F.element_at(second, near["j"] + 1).alias("b"))
        return F.when(fits, F.struct(F.array_append(state["used"], near["j"]).alias("used"), F.array_append(state["pairs"], pair).alias("pairs"))).otherwise(state)

    empty = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>").alias("pairs"))
    return F.aggregate(first, empty, take)["pairs"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _spread(points: Column, tolerance: float) -> Column:
    """Whether no two points are within twice the tolerance, and a bit, of each other."""
    gaps = lambda x: F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)
    sorted_ = F.sort_array(F.transform(points, lambda p: F.log10(p["frequency_hz"])))
    return _let(sorted_, lambda x: F.when(F.size(x) < 2, F.lit(True)).otherwise(F.array_min(gaps(x)) > 2.001 * tolerance))


def align(first: Column, second: Column, tolerance: float = TOLERANCE) -> Column:
    """array<struct<a, b>> of points of two spectra at the same frequency. Frequencies are positive.

    Each point of the first takes the nearest of the second in |log10 f| (the earliest of equals) if within the tolerance and not
    taken yet. Both are in order of acquisition.

    Where no two points of a spectrum are within twice the tolerance, as in almost all, a point has at most one partner, which stands
    next to it when the points of both are sorted by frequency; others are compared point by point.
    """

    def merged() -> Column:
        tagged = lambda points, side: F.transform(points, lambda p, i: F.struct(F.log10(p["frequency_hz"]).alias("x"), F.lit(side).alias("side"), i.alias("i")))
        both = F.sort_array(F.concat(tagged(first, 0), tagged(second, 1)))
        near = lambda u, v: (u["side"] != v["side"]) & (F.abs(v["x"] - u["x"]) <= tolerance)
        found = lambda z: F.filter(F.zip_with(F.slice(z, 1, F.greatest(F.size(z) - 1, F.lit(0))), F.slice(z, 2, F.greatest(F.size(z) - 1, F.lit(0))), lambda u, v: F.when(near(u, v), F.struct(F.when(u["side"] == 0, u["i"]).otherwise(v["i"]).alias("i"), F.when(u["side"] == 0, v["i"]).otherwise(u["i"]).alias("j")))), lambda m: m.isNotNull())
        return F.transform(F.sort_array(_let(both, found)), lambda m: F.struct(F.get(first, m["i"]).alias("a"), F.get(second, m["j"]).alias("b")))

    return F.when(_spread(first, tolerance) & _spread(second, tolerance), merged()).otherwise(_greedy(first, second, tolerance))


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs (uid_1, uid_2, basis_1, basis_2, points_1, points_2 and any others) with status, common_points, rms_percent,
    median_percent, max_percent. Bases must be equal, and at least five points and 80 % of the longer spectrum in common."""
    p = pairs.withColumn("_m", align(F.col("points_1"), F.col("points_2")))
    enough = (F.size("_m") >= 5) & (F.size("_m") >= 0.8 * F.greatest(F.size("points_1"), F.size("points_2")))
    p = p.withColumn("_ok", (F.col("basis_1") == F.col("basis_2")) & enough)
    mean = lambda x: (F.hypot(x["a"]["zreal"], x["a"]["neg_zimag"]) + F.hypot(x["b"]["zreal"], x["b"]["neg_zimag"])) / 2
    p = p.withColumn("_h", F.sort_array(F.transform("_m", mean)))
    mid = lambda c: (F.get(c, F.floor((F.size(c) - 1) / 2).cast("int")) + F.get(c, F.floor(F.size(c) / 2).cast("int"))) / 2
    p = p.withColumn("_floor", F.greatest(mid(F.col("_h")) * 1e-12, F.lit(TINY)))
    gap = lambda x: F.hypot(x["b"]["zreal"] - x["a"]["zreal"], x["b"]["neg_zimag"] - x["a"]["neg_zimag"])
    p = p.withColumn("_r", F.sort_array(F.transform("_m", lambda x: 100 * gap(x) / F.greatest(mean(x), F.col("_floor")))))
    square = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x * x)
    only = lambda c: F.when(F.col("_ok"), c)
    return p.select(
        *pairs.columns, F.when(F.col("_ok"), "completed").otherwise("not-assessable").alias("status"), only(F.size("_m")).alias("common_points"),
        only(F.sqrt(square / F.size("_r"))).alias("rms_percent"), only(mid(F.col("_r"))).alias("median_percent"), only(F.element_at("_r", -1)).alias("max_percent"),
    )


def pairs_within(spectra: DataFrame, group: str, *levels: str) -> DataFrame:
    """All pairs of a group's spectra, once each, with columns of both under _1 and _2."""
    own = spectra.where(F.col(group).isNotNull())
    a = own.select(F.col(group).alias("grp"), *[F.col(c).alias(f"{c}_1") for c in ("uid", "basis", "points", *levels)])
    b = own.select(F.col(group).alias("grp"), *[F.col(c).alias(f"{c}_2") for c in ("uid", "basis", "points", *levels)])
    return a.join(b, "grp").where("uid_1 < uid_2")


def repeat_peak_status(spectra: DataFrame, peaks: DataFrame, group: str = "repeat_id") -> DataFrame:
    """uid_1, uid_2, peak_status of the pairs of a group, by their major peaks in the range of common frequencies: what
    repeat_assessment() takes as `peaks`.

    `peaks` has a row a peak (uid, frequency_hz, relative_height, area_impedance, confidence). A pair without common frequencies, or
    without major peaks, is not-assessable; a spectrum without rows has no peaks.
    """
    fields = ("frequency_hz", "relative_height", "area_impedance", "confidence")
    of_uid = peaks.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("found"))
    pairs = pairs_within(spectra, group).select("uid_1", "uid_2", F.transform(align(F.col("points_1"), F.col("points_2")), lambda m: m["a"]["frequency_hz"]).alias("common"))
    pairs = pairs.select("uid_1", "uid_2", F.array_min("common").alias("lowest"), F.array_max("common").alias("highest"))
    for side in ("1", "2"):
        pairs = pairs.join(of_uid.select(F.col("uid").alias(f"uid_{side}"), F.col("found").alias(f"peaks_{side}")), f"uid_{side}", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = lambda found: [] if found is None else [dict(p) for p in found]
            status = [repeat_peaks(own(r.peaks_1), own(r.peaks_2), r.lowest, r.highest) for r in batch.itertuples(index=False)]
            yield batch[["uid_1", "uid_2"]].assign(peak_status=status)

    uid = dict(spectra.dtypes)["uid"]
    return pairs.select("uid_1", "uid_2", "lowest", "highest", "peaks_1", "peaks_2").mapInPandas(judge, f"uid_1 {uid}, uid_2 {uid}, peak_status string")


def repeat_assessment(spectra: DataFrame, group: str = "repeat_id", peaks: DataFrame | None = None, warn: float = WARN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(groups: grp, members, status, max_rms_percent; members: grp, uid, score, modified_z, outlier).

    `peaks` may give (uid_1, uid_2, peak_status) of pairs; pairs without it count as not assessable in their peaks. A member's score
    is its least pair RMS in groups of three, else the median; an outlier is over the warning level and over 3.5 modified z, or
    over three times the centre where the MAD vanishes.
    """
    members = spectra.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    pairs = compare(pairs_within(spectra, group)).select("grp", "uid_1", "uid_2", "status", "rms_percent")
    if peaks is not None:
        pairs = pairs.join(peaks, ["uid_1", "uid_2"], "left")
    else:
        pairs = pairs.withColumn("peak_status", F.lit(None).cast("string"))
    of_group = pairs.groupBy("grp").agg(
        F.bool_and(F.col("status") == "completed").alias("assessable"), F.max("rms_percent").alias("max_rms_percent"),
        F.bool_or(F.coalesce(F.col("peak_status"), F.lit("")) == "changed-materially").alias("changed"), F.bool_or(F.coalesce(F.col("peak_status"), F.lit("")) != "accepted").alias("unsure"),
    ).join(members, "grp")
    each = pairs.select("grp", F.explode(F.array("uid_1", "uid_2")).alias("uid"), "rms_percent").join(of_group.where("assessable AND members >= 3").select("grp", "members"), "grp")
    scores = each.groupBy("grp", "uid", "members").agg(F.min("rms_percent").alias("least"), F.median("rms_percent").alias("mid")).select("grp", "uid", F.when(F.col("members") == 3, F.col("least")).otherwise(F.col("mid")).alias("score"))
    w = Window.partitionBy("grp")
    scores = scores.withColumn("centre", F.median("score").over(w)).withColumn("mad", F.median(F.abs(F.col("score") - F.col("centre"))).over(w))
    z = F.when(F.col("mad") > 1e-12, 0.6745 * (F.col("score") - F.col("centre")) / F.col("mad"))
    over = F.when(z.isNotNull(), z > 3.5).otherwise(F.col("score") > F.greatest(F.lit(warn), 3 * F.col("centre")))
    scores = scores.select("grp", "uid", "score", z.alias("modified_z"), ((F.col("score") > warn) & over).alias("outlier"))
    any_outlier = scores.groupBy("grp").agg(F.bool_or("outlier").alias("has_outlier"))
    status = (
        F.when(F.coalesce("has_outlier", F.lit(False)), "repeat-outlier-detected").when(~F.col("assessable"), "not-assessable").when(F.col("max_rms_percent") > warn, "repeat-disagreement")
        .when(F.col("changed"), "repeat-peak-disagreement").when(F.col("unsure"), "repeat-peak-not-assessable").when(F.col("members") >= 3, "repeat-supported").otherwise("pair-only")
    )
    return of_group.join(any_outlier, "grp", "left").select("grp", "members", status.alias("status"), "max_rms_percent"), scores


def linearity_assessment(spectra: DataFrame, group: str = "linearity_id", warn: float = WARN_PERCENT) -> DataFrame:
    """grp, members, levels, status, max_rms_percent for groups with two or more positive amplitudes (column amplitude_mv)."""
    own = spectra.where(F.col("amplitude_mv") > 0)
    members = own.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("amplitude_mv").alias("levels")).where("levels >= 2")
    pairs = compare(pairs_within(own, group)).groupBy("grp").agg(F.bool_and(F.col("status") == "completed").alias("ok"), F.max("rms_percent").alias("max_rms_percent"))
    status = F.when(~F.col("ok"), "not-assessable").when(F.col("max_rms_percent") <= warn, "linearity-supported").otherwise("amplitude-dependent")
    return members.join(pairs, "grp").select("grp", "members", "levels", status.alias("status"), "max_rms_percent")


def stationarity_assessment(spectra: DataFrame, group: str = "stationarity_id", warn: float = WARN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(groups: grp, levels, status, last_rms_percent; supported: grp, uid) by rest time (column rest_time_s, at least 0).

    What counts are the pairs across the last two levels and the repeats within either. Two levels alone are no plateau; only
    spectra of the last two levels are supported by one.
    """
    w = Window.partitionBy(group)
    own = spectra.where((F.col("rest_time_s") >= 0) & F.col(group).isNotNull()).withColumn("rank", F.dense_rank().over(w.orderBy("rest_time_s"))).withColumn("levels", F.max("rank").over(w)).where("levels >= 2")
    late = own.where("rank >= levels - 1")
    checks = compare(pairs_within(late, group, "levels")).groupBy("grp").agg(F.first("levels_1").alias("levels"), F.bool_and(F.col("status") == "completed").alias("ok"), F.max("rms_percent").alias("last_rms_percent"))
    status = F.when(~F.col("ok"), "not-assessable").when(F.col("levels") == 2, "two-rest-discrepancy-only").when(F.col("last_rms_percent") <= warn, "rest-stable").otherwise("rest-dependent")
    groups = checks.select("grp", "levels", status.alias("status"), "last_rms_percent")
    supported = late.select(F.col(group).alias("grp"), "uid").join(groups.where("status = 'rest-stable'").select("grp"), "grp", "left_semi")
    return groups, supported


def evidence(spectra: DataFrame, repeat: DataFrame, linearity: DataFrame, stationarity: DataFrame, supported: DataFrame) -> DataFrame:
    """uid, repeat, linearity, stationarity, evidence_status. A control that is missing is evidence-missing, never a pass."""
    out = spectra.select("uid", "repeat_id", "linearity_id", "stationarity_id")
    for name, groups in (("repeat", repeat), ("linearity", linearity), ("stationarity", stationarity)):
        out = out.join(groups.select(F.col("grp").alias(f"{name}_id"), F.col("status").alias(f"{name}_status")), f"{name}_id", "left")
    out = out.join(supported.select("uid", F.lit(True).alias("late")), "uid", "left")

    def control(name: str) -> Column:
        s = F.col(f"{name}_status")
        good = s.isin(*SUPPORTED) & (F.coalesce("late", F.lit(False)) if name == "stationarity" else F.lit(True))
        return F.when(s.isin(*ADVERSE), "contradicted").when(good, "supported").otherwise("evidence-missing")

    out = out.select("uid", *[control(n).alias(n) for n in ("repeat", "linearity", "stationarity")])
    each = F.array("repeat", "linearity", "stationarity")
    state = F.when(F.array_contains(each, "contradicted"), "contradicted").when(F.size(F.array_distinct(each)) * 10 + F.array_contains(each, "supported").cast("int") == 11, "supported").otherwise("evidence-missing")
    return out.withColumn("evidence_status", state)


def verdicts(results: DataFrame) -> DataFrame:
    """numeric_status, validity_status, display_role, claim_level, decision_basis for results with evidence_status.

    Columns of results: uid, completed, kk_status, kk_subset, lambda_boundary, rms_re_percent, rms_im_percent, drift_status,
    nonseries, diffusion, signed_status, signed_sensitivity, signed_lambda_boundary, ddt_status, ddt_selection, inductance_off,
    major_unresolved, poles_incompatible, major_noise_sensitive, evidence_status; missing values count as absent.
    """
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    bad_rms = F.col("rms_re_percent").isNull() | F.col("rms_im_percent").isNull() | (F.least("rms_re_percent", "rms_im_percent") < 0)
    signed = t("signed_status") == "completed"
    ladder = [
        (~b("completed"), "computation-not-completed"),
        (~t("kk_status").isin("screen-pass", "passed", "pass"), "KK-not-screen-pass"),
        (b("kk_subset"), "KK-subset-needs-full-point-confirmation"),
        (b("lambda_boundary"), "lambda-boundary-sensitive"),
        (bad_rms, "primary-reconstruction-RMS-missing-or-nonfinite"),
        (~bad_rms & (F.hypot("rms_re_percent", "rms_im_percent") > 2.0), "primary-reconstruction-RMS-above-2-percent-heuristic"),
        (t("drift_status") == "structured-drift-suspect", "structured-residual-drift"),
        (b("nonseries") & ~signed, "signed_gdrt-required-not-completed"),
        (b("diffusion") & (t("ddt_status") != "completed"), "ddt-required-not-completed"),
        (b("nonseries") & (t("signed_sensitivity") == "sensitive"), "signed-distribution-sensitive"),
        (signed & b("signed_lambda_boundary"), "signed-lambda-boundary-sensitive"),
        (signed & (t("signed_sensitivity") == "range-incomplete"), "signed-lambda-range-incomplete"),
        (b("diffusion") & (t("ddt_selection") == "no-distribution-candidate-accepted"), "diffusion-topology-or-timescale-unresolved"),
        (b("nonseries"), "ordinary-RC-kernel-incompatible"),
        (b("inductance_off"), "inductance-disabled-compatibility-only"),
        (b("major_unresolved"), "major-peak-unresolved"),
        (b("poles_incompatible"), "predictive-in-band-poles-not-RC-RL-compatible"),
        (b("major_noise_sensitive"), "major-peak-noise-or-resolution-sensitive"),
    ]
    r = results.withColumn("_reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in ladder])))
    some = F.size("_reasons") > 0
    numeric = F.when(~b("completed") & ~b("major_noise_sensitive"), "failed").when(some, "review-required").otherwise("supported")
    r = r.withColumn("numeric_status", numeric)
    contradicted = t("evidence_status") == "contradicted"
    r = r.withColumn("validity_status", F.when((F.col("numeric_status") != "supported") | contradicted, "review-required").when(t("evidence_status") == "supported", "accepted-with-supplied-controls").otherwise("controls-incomplete-no-acceptance"))
    display = F.when(F.col("validity_status") == "accepted-with-supplied-controls", "included").when(~b("completed"), "review-pending").when(some | contradicted, "diagnostic-only").otherwise("included-exploratory")
    return r.select(
        *results.columns, "numeric_status", "validity_status", display.alias("display_role"), F.when(F.col("numeric_status") == "supported", "numerically_supported_mechanism_unassigned").otherwise("diagnostic_only").alias("claim_level"),
        F.when(some, F.col("_reasons")).otherwise(F.array(F.lit("numerical-screens-supported"))).alias("decision_basis"),
    )


def overall(verdicts_: DataFrame) -> DataFrame:
    """One row: overall_verdict and the number of each validity_status. No spectra need review."""
    v = F.col("validity_status")
    return verdicts_.agg(
        F.when((F.count(F.lit(1)) == 0) | F.bool_or(v == "review-required"), "review-required").when(F.bool_and(v == "accepted-with-supplied-controls"), "accepted-with-supplied-controls").otherwise("controls-incomplete-no-acceptance").alias("overall_verdict"),
        F.count_if(v == "review-required").alias("n_review"), F.count_if(v == "accepted-with-supplied-controls").alias("n_accepted"), F.count_if(v == "controls-incomplete-no-acceptance").alias("n_incomplete"),
    )
