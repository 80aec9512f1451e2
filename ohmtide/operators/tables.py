"""Tables for publication: paired wide columns, shared-grid matrices, trend windows, and what an earlier run has done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(base: DataFrame, source_meta: DataFrame, exact_meta: DataFrame, path: str, spectrum: str) -> DataFrame:
    """base with `metadata`: what the manifest says of its source, overlaid by what it says of the very spectrum.

    source_meta: (path, metadata map); exact_meta: (path, spectrum, metadata map).
    """
    empty = F.create_map().cast("map<string,string>")
    a = source_meta.select(F.col(path), F.col("metadata").alias("_a"))
    b = exact_meta.select(F.col(path), F.col(spectrum), F.col("metadata").alias("_b"))
    joined = base.join(a, path, "left").join(b, [path, spectrum], "left")
    left, right = F.coalesce("_a", empty), F.coalesce("_b", empty)
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return joined.select(*base.columns, F.map_concat(kept, right).alias("metadata"))


def manifest_faults(manifest: DataFrame, path: str, spectrum: str) -> DataFrame:
    """path, spectrum, fault: blank paths and repeated keys, either of which refuses a manifest."""
    blank = manifest.where(F.trim(F.coalesce(path, F.lit(""))) == "").select(path, spectrum, F.lit("blank-path").alias("fault"))
    twice = manifest.groupBy(path, spectrum).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(path, spectrum, F.lit("duplicate-key").alias("fault"))
    return blank.unionByName(twice)


def row_selected(include, role):
    """Whether an inventory row is taken: not excluded by a word for no, and of an impedance role (or none)."""
    no = F.lower(F.trim(F.coalesce(include, F.lit("")))).isin("0", "false", "no", "n", "exclude", "excluded")
    return ~no & F.lower(F.trim(F.coalesce(role, F.lit("")))).isin("", "eis", "impedance", "auto")


def wide_pairs(curves: DataFrame, key: str, order: str, x: str, y: str, names: list) -> DataFrame:
    """row and, for each name, its x and y side by side by rank: `<name>_x`, `<name>_y`. Curves may differ in length and grid."""
    ranked = curves.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.groupBy("row").pivot(key, names).agg(F.first(x).alias("x"), F.first(y).alias("y"))


def shared_grid(curves: DataFrame, group: str, key: str, x: str, decimals: int = 12) -> DataFrame:
    """group, members, grids: one grid means that a matrix of the group's curves needs no interpolation."""
    grids = curves.groupBy(group, key).agg(F.sort_array(F.collect_list(F.round(x, decimals))).alias("grid"))
    return grids.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("grid").alias("grids"))


def exact_matrix(curves: DataFrame, key: str, x: str, y: str, names: list) -> DataFrame:
    """x and a column for each curve, on the grid that they share; check with shared_grid() before."""
    return curves.groupBy(x).pivot(key, names).agg(F.first(y))


def common_window(curves: DataFrame, group: str, key: str, x: str) -> DataFrame:
    """Points of each group's curves inside the range of x that all its curves cover."""
    extents = curves.groupBy(group, key).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).groupBy(group).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return curves.join(extents, group).where(F.col(x).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def cell_edges(points: DataFrame, by: str, x: str) -> DataFrame:
    """Points with left and right, the edges of their cells: halfway to the neighbours, and as far outside at the ends."""
    w = Window.partitionBy(by).orderBy(x)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    left = F.coalesce((F.col(x) + before) / 2, F.col(x) - (after - F.col(x)) / 2, F.col(x))
    right = F.coalesce((F.col(x) + after) / 2, F.col(x) + (F.col(x) - before) / 2, F.col(x))
    return points.withColumns({"left": left, "right": right})


def trend_order(spectra: DataFrame, group: str, page: int = 20) -> DataFrame:
    """rank and page of spectra by voltage: rising in charge, falling in discharge, uid breaking ties."""
    down = F.lower(F.coalesce("direction", F.lit(""))) == "discharge"
    w = Window.partitionBy(group).orderBy(F.when(down, -F.col("voltage_v")).otherwise(F.col("voltage_v")), "uid")
    return spectra.withColumn("rank", F.row_number().over(w)).withColumn("page", F.floor((F.col("rank") - 1) / page) + 1)


def pending(spectra: DataFrame, checkpoint: DataFrame, fingerprint: str) -> DataFrame:
    """Spectra that no completed row of the checkpoint covers under this run's fingerprint."""
    done = checkpoint.where((F.col("fingerprint") == fingerprint) & (F.col("status") == "completed")).select("uid")
    return spectra.join(done, "uid", "left_anti")


def trend_eligibility(results: DataFrame) -> DataFrame:
    """results with plot_reason: the first rule that keeps a spectrum out of trend panels, else eligible-awaiting-group.

    Columns read: status, ordinary_rc_eligible, display_role, cell_id, sample_id, direction, voltage_v, basis.
    """
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.coalesce("status", F.lit("")) != "completed", "numerical-not-completed").when(~F.coalesce("ordinary_rc_eligible", F.lit(False)), "not-ordinary-RC-eligible")
        .when(~F.coalesce("display_role", F.lit("")).isin("included", "included-exploratory"), "diagnostic-or-unreviewed-display-role")
        .when(absent("cell_id") & absent("sample_id"), "missing-cell-or-sample-identity").when(absent("direction"), "missing-direction")
        .when(F.col("voltage_v").isNull() | F.isnan("voltage_v"), "missing-finite-voltage").when(~F.coalesce("basis", F.lit("")).isin("ohm", "ohm_cm2"), "unsupported-or-missing-impedance-basis")
        .otherwise("eligible-awaiting-group")
    )
    return results.withColumn("plot_reason", reason)


def display_limits(points: DataFrame, by: str, value: str, pad: float = 0.06) -> DataFrame:
    """by, unit_factor, low, high: a thousandth of the unit where the largest magnitude is under 0.1, and the range with 6 % on each
    side (of the value, or of one, where there is no range)."""
    s = points.groupBy(by).agg(F.max(F.abs(value)).alias("top"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    factor = F.when(F.col("top") < 0.1, 1000.0).otherwise(1.0)
    span = F.col("hi") - F.col("lo")
    edge = pad * F.when(span > 0, span).when(F.col("top") > 0, F.col("top")).otherwise(1.0)
    return s.select(by, factor.alias("unit_factor"), ((F.col("lo") - edge) * factor).alias("low"), ((F.col("hi") + edge) * factor).alias("high"))


def quantities(points: DataFrame, kk: DataFrame | None = None) -> DataFrame:
    """The impedance-only table of points: omega, tau, modulus, phase, and the spectrum's numeric_status. Without a consistency test
    (uid, kk_status) a spectrum is parsed-not-screened; one that only warns or fails needs review."""
    from ohmtide.functions import scalars as S

    f, re, im = F.col("frequency_hz"), F.col("zreal"), F.col("neg_zimag")
    base = points.withColumns({"omega": S.omega(f), "tau_s": S.tau(f), "modulus": S.modulus(re, im), "phase_degrees": S.phase_degrees(re, im)})
    if kk is None:
        return base.withColumn("numeric_status", F.lit("parsed-not-screened"))
    status = F.when(F.col("kk_status").isNull(), "parsed-not-screened").when(F.col("kk_status") == "screen-pass", "consistency-screen-pass").otherwise("review-required")
    return base.join(kk.select("uid", "kk_status"), "uid", "left").withColumn("numeric_status", status).drop("kk_status")
