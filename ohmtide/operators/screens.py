"""Screens and measures of spectra, from points (uid, i, frequency_hz, zreal, neg_zimag): aggregates and windows only.

A window of a whole spectrum holds its points, at most some hundreds; the shuffle is by uid, and partial sums go before it where
an aggregate suffices. Statistics of a group that its rows need (medians, maxima) are window aggregates over the uid.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmtide.functions.scalars import modulus, omega

TINY = 2.2250738585072014e-308


def _spectrum():
    return Window.partitionBy("uid")


def _high() -> Column:
    """Whether a point is in the highest decade."""
    return F.col("frequency_hz") >= F.col("fmax") / 10


def _with_extent(points: DataFrame) -> DataFrame:
    return points.withColumn("fmax", F.max("frequency_hz").over(_spectrum()))


def series_inductance(points: DataFrame) -> DataFrame:
    """uid, n_high, inductance_h, intercept_ohm, r_squared, explainable: -Im Z against omega over the highest decade.

    Fewer than five points: no fit, L is 0. L is never negative; a flat response has no r_squared.
    """
    x, y = omega(F.col("frequency_hz")), F.col("neg_zimag")
    fits = _with_extent(points).where(_high()).groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_high"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("spread"),
    )
    fit = F.col("n_high") >= 5
    l = F.when(fit, F.greatest(F.lit(0.0), -F.col("slope"))).otherwise(0.0)
    r2 = F.when(fit & (F.col("spread") * F.col("n_high") > TINY), F.col("r2"))
    return fits.select("uid", "n_high", l.alias("inductance_h"), F.when(fit, F.col("intercept")).alias("intercept_ohm"), r2.alias("r_squared"), F.coalesce((l > 0) & (r2 >= 0.90), F.lit(False)).alias("explainable"))


def high_frequency_inductance(points: DataFrame) -> DataFrame:
    """uid, n_high, n_negative, threshold, detected: materially negative -Im Z in the highest decade."""
    scale = F.greatest(F.percentile(F.abs("neg_zimag"), F.lit(0.75)).over(_spectrum()), F.lit(TINY))
    p = _with_extent(points).withColumn("threshold", 0.002 * scale)
    found = p.groupBy("uid").agg(F.count_if(_high()).alias("n_high"), F.count_if(_high() & (F.col("neg_zimag") < -F.col("threshold"))).alias("n_negative"), F.max("threshold").alias("threshold"))
    return found.withColumn("detected", (F.col("n_high") >= 3) & (F.col("n_negative") >= 3))


def longest_run(rows: DataFrame, flag: Column, order: Column, by: str = "uid") -> DataFrame:
    """by, longest: the longest run of rows in order for which flag holds; 0 if none does."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(w))
    runs = marked.groupBy(by, "_island").agg(F.count_if("_flag").alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("longest"))


def nonseries_inductance(points: DataFrame, noise_aware: bool = True) -> DataFrame:
    """uid, n_negative, longest, detected: inductive response under the highest decade once a plausible series L is taken out.

    The threshold is 0.2 % of the 75th percentile of |-Im Z|, and with noise_aware also three times the local roughness: the MAD of
    what a point differs from the line between its neighbours in ln f, relative to the modulus (from seven points of distinct f).
    """
    l = series_inductance(points).select("uid", F.when(F.col("explainable"), F.col("inductance_h")).otherwise(0.0).alias("l"))
    order = Window.partitionBy("uid").orderBy(F.desc("frequency_hz"))
    raw_threshold = 0.002 * F.greatest(F.percentile(F.abs("neg_zimag"), F.lit(0.75)).over(_spectrum()), F.lit(TINY))
    p = _with_extent(points).join(l, "uid").withColumns({
        "base": raw_threshold, "y": F.col("neg_zimag") + omega(F.col("frequency_hz")) * F.col("l"),
        "mag": F.greatest(modulus(F.col("zreal"), F.col("neg_zimag")), F.median(modulus(F.col("zreal"), F.col("neg_zimag"))).over(_spectrum()) * 1e-12, F.lit(TINY)),
        "n": F.count(F.lit(1)).over(_spectrum()), "x": F.log("frequency_hz"),
    })
    p = p.withColumn("v", F.col("y") / F.col("mag"))
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    left = (after("x") - F.col("x")) / (after("x") - before("x"))
    p = p.withColumns({"left": left, "same": F.coalesce(before("x") == F.col("x"), F.lit(False)), "residual": F.col("v") - left * before("v") - (1 - left) * after("v")})
    p = p.withColumns({"residual": F.col("residual") / F.sqrt(1 + F.col("left") * F.col("left") + (1 - F.col("left")) * (1 - F.col("left"))), "ties": F.max("same").over(_spectrum())})
    p = p.withColumn("centre", F.median("residual").over(_spectrum())).withColumn("sigma", 1.4826 * F.median(F.abs(F.col("residual") - F.col("centre"))).over(_spectrum()))
    floor = F.when((F.col("n") >= 7) & ~F.col("ties"), 3 * F.col("sigma") * F.col("mag")) if noise_aware else F.lit(None).cast("double")
    p = p.withColumn("threshold", F.greatest("base", F.coalesce(floor, "base")))
    flag = (F.col("y") < -F.col("threshold")) & ~_high()
    runs = longest_run(p, flag, F.desc("frequency_hz"))
    counts = p.groupBy("uid").agg(F.count_if(flag).alias("n_negative"))
    return counts.join(runs, "uid").withColumn("detected", F.col("longest") >= 3)


def diffusion_tail(points: DataFrame) -> DataFrame:
    """uid, n_low, nyquist_slope, magnitude_slope, detected: growth towards low frequency of capacitive or diffusive kind."""
    p = points.withColumns({
        "mag": modulus(F.col("zreal"), F.col("neg_zimag")), "n": F.count(F.lit(1)).over(_spectrum()),
        "rank": F.row_number().over(Window.partitionBy("uid").orderBy("frequency_hz", "i")),
    }).withColumn("mid", F.median("mag").over(_spectrum()))
    low = p.where(F.col("rank") <= F.greatest(F.lit(5), F.ceil(0.18 * F.col("n"))))
    span = lambda c: F.max(c) - F.min(c)
    found = low.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_low"), span("zreal").alias("dx"), span("neg_zimag").alias("dy"), F.median("neg_zimag").alias("y"), span("mag").alias("growth"), F.max("mid").alias("mid"),
        F.regr_slope(F.log10(F.greatest("mag", F.lit(TINY))), F.log10("frequency_hz")).alias("magnitude_slope"),
    )
    slope = F.when(F.col("dx") > 2.3e-308, F.col("dy") / F.col("dx"))
    oriented = F.coalesce(slope.between(0.15, 8.0), F.lit(False)) | (F.col("magnitude_slope") < -0.20)
    return found.select("uid", "n_low", slope.alias("nyquist_slope"), "magnitude_slope", ((F.col("y") > 0) & oriented & (F.col("growth") > 0.02 * F.greatest("mid", F.lit(TINY)))).alias("detected"))


def drift_screen(pairs: DataFrame) -> DataFrame:
    """From (uid, i in acquisition order, zreal, neg_zimag, fit_zreal, fit_neg_zimag): uid, status, trend_span_percent,
    detrended_rms_percent, residual_rms_percent. Fewer than 15 points can't be assessed."""
    mag = modulus(F.col("zreal"), F.col("neg_zimag"))
    p = pairs.withColumns({"mag": F.greatest(mag, F.median(mag).over(_spectrum()) * 1e-12, F.lit(TINY)), "n": F.count(F.lit(1)).over(_spectrum()), "r": F.row_number().over(Window.partitionBy("uid").orderBy("i"))})
    p = p.withColumns({"x": (F.col("r") - 1) / F.greatest(F.col("n") - 1, F.lit(1)) - 0.5, "re": (F.col("zreal") - F.col("fit_zreal")) / F.col("mag"), "im": (F.col("fit_neg_zimag") - F.col("neg_zimag")) / F.col("mag")})
    # With x centred, what a trend leaves of a sum of squares is n (var y - slope^2 var x).
    s = p.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("re", "x").alias("br"), F.regr_slope("im", "x").alias("bi"), F.var_pop("re").alias("vr"), F.var_pop("im").alias("vi"), F.var_pop("x").alias("vx"),
        F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("ms"),
    )
    span = 100 * F.hypot("br", "bi")
    rest = 100 * F.sqrt(F.greatest(F.col("vr") + F.col("vi") - (F.col("br") * F.col("br") + F.col("bi") * F.col("bi")) * F.col("vx"), F.lit(0.0)))
    status = F.when(F.col("n") < 15, "not-assessable").when((span > 0.5) & (span > 1.5 * F.greatest(rest, F.lit(TINY))), "structured-drift-suspect").otherwise("no-strong-monotonic-drift")
    return s.select("uid", status.alias("status"), span.alias("trend_span_percent"), rest.alias("detrended_rms_percent"), (100 * F.sqrt("ms")).alias("residual_rms_percent"))


def residual_measures(pairs: DataFrame) -> DataFrame:
    """The four residual measures, which are not the same, for points with fit_zreal and fit_neg_zimag:
    component_rms_re_percent and _im_percent, relative_complex_rms_percent, quality_log10, symmetric_rms_percent."""
    mag, fit = modulus(F.col("zreal"), F.col("neg_zimag")), modulus(F.col("fit_zreal"), F.col("fit_neg_zimag"))
    p = pairs.withColumns({"m": mag, "h": (mag + fit) / 2, "dr": F.col("fit_zreal") - F.col("zreal"), "di": F.col("fit_neg_zimag") - F.col("neg_zimag")})
    p = p.withColumns({"m": F.greatest("m", F.median("m").over(_spectrum()) * 1e-12, F.lit(TINY)), "h": F.greatest("h", F.median("h").over(_spectrum()) * 1e-12, F.lit(TINY))})
    sq = lambda a, b: F.avg((F.col(a) / F.col(b)) * (F.col(a) / F.col(b)))
    s = p.groupBy("uid").agg(sq("dr", "m").alias("re"), sq("di", "m").alias("im"), (sq("dr", "h") + sq("di", "h")).alias("sym"))
    both = F.col("re") + F.col("im")
    return s.select(
        "uid", (100 * F.sqrt("re")).alias("component_rms_re_percent"), (100 * F.sqrt("im")).alias("component_rms_im_percent"), (100 * F.sqrt(both)).alias("relative_complex_rms_percent"),
        F.log10(F.greatest(F.sqrt(both / 2), F.lit(TINY))).alias("quality_log10"), (100 * F.sqrt("sym")).alias("symmetric_rms_percent"),
    )


def nuisance_eligibility(points: DataFrame) -> DataFrame:
    """uid, series_l, series_c, c_slope, diffusion: which simple elements a spectrum gives reason to try."""
    p = points.withColumns({"fmax": F.max("frequency_hz").over(_spectrum()), "fmin": F.min("frequency_hz").over(_spectrum())})
    low = (F.col("frequency_hz") <= F.col("fmin") * 10**1.5) & (F.col("neg_zimag") > 0)
    s = p.groupBy("uid").agg(
        (F.count_if(_high() & (F.col("neg_zimag") < 0)) >= 3).alias("series_l"), F.count_if(low).alias("n"),
        F.regr_slope(F.when(low, F.log10("neg_zimag")), F.when(low, F.log10("frequency_hz"))).alias("slope"),
    )
    slope = F.when(F.col("n") >= 4, F.col("slope"))
    tail = diffusion_tail(points).select("uid", F.col("detected").alias("diffusion"))
    return s.select("uid", "series_l", F.coalesce(slope.between(-1.35, -0.65), F.lit(False)).alias("series_c"), slope.alias("c_slope")).join(tail, "uid")


__all__ = ["diffusion_tail", "drift_screen", "high_frequency_inductance", "longest_run", "nonseries_inductance", "nuisance_eligibility", "residual_measures", "series_inductance"]
