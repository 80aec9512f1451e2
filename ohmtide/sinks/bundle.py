"""A run's tables for release, each with the identity and verdict of its spectrum, and a short report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmtide.functions.scalars import six_digits

COMMON = ("label", "source_uid", "basis", "numeric_status", "validity_status", "display_role", "evidence_status")


def bundle(tables: dict[str, DataFrame], identity: DataFrame) -> dict[str, DataFrame]:
    """Every table with COMMON columns (those that `identity` has) by uid. Rows whose spectrum has no identity are an error of the
    caller and come out with nulls; a uid with several identities is refused."""
    twice = identity.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"spectrum {twice[0].uid} has several identities")
    own = identity.select("uid", *[c for c in COMMON if c in identity.columns])
    out = {}
    for name, table in tables.items():
        clash = [c for c in own.columns if c in table.columns and c != "uid"]
        out[name] = table.drop(*clash).join(own, "uid", "left")
    return out


def report(results: DataFrame, peaks: DataFrame, most: int = 50) -> str:
    """Markdown: counts of verdicts, then the first spectra and their peaks (a page for people; whole tables are in the bundle)."""
    status = {r.status: r.n for r in results.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = ["# Analysis of relaxation times", "", *(f"- {k}: {v}" for k, v in sorted(status.items())), "", "| spectrum | lambda | RMS Re % | RMS Im % | KK | branch |", "|---|---|---|---|---|---|"]
    columns = [six_digits(F.col(c)).alias(c) for c in ("lambda", "rms_re_percent", "rms_im_percent")]
    for r in results.where("status = 'completed'").select("uid", *columns, "kk_status", "recommended").orderBy("uid").limit(most).collect():
        lines.append(f"| {r.uid} | {r['lambda']} | {r.rms_re_percent} | {r.rms_im_percent} | {r.kk_status} | {r.recommended} |")
    lines += ["", "| spectrum | peak | frequency Hz | area | confidence |", "|---|---|---|---|---|"]
    for r in peaks.select("uid", "peak_id", six_digits(F.col("frequency_hz")).alias("f"), six_digits(F.col("area_impedance")).alias("a"), "confidence").orderBy("uid", "peak_id").limit(most).collect():
        lines.append(f"| {r.uid} | {r.peak_id} | {r.f} | {r.a} | {r.confidence} |")
    return "\n".join([*lines, "", "Peaks are numerical; none is assigned to a mechanism.", ""])
