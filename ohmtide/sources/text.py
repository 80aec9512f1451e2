"""Delimited text to spectra, with a ledger of every line: expressions and windows over `binaryFile`, one row a file until lines are
dealt out. A file that can't be read is a row with its error; no line is lost, and none is guessed."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmtide.functions import scalars as S
from ohmtide.operators.sequence import sweep_runs
from ohmtide.sources.ledger import exclusion_reason

DELIMITERS = {"tab": "\t", "comma": ",", "semicolon": ";", "whitespace": "whitespace"}
ENCODINGS = ("gb18030", "utf-16", "latin-1")
LOOK = 300


@dataclass(frozen=True)
class Layout:
    """What the caller declares: a delimiter, a header row (from 1), columns by role (from 0), no header at all, units, the sign's
    convention and the order. `auto` leaves it to the header's words."""

    delimiter: str = "auto"
    header_row: int | None = None
    headerless: bool = False
    columns: dict[str, int] = field(default_factory=dict)
    frequency_unit: str = "auto"
    impedance_unit: str = "auto"
    imag_convention: str = "auto"
    order: str = "acquisition"

    def __post_init__(self):
        if self.delimiter not in ("auto", *DELIMITERS) or self.order not in ("acquisition", "single-spectrum-descending"):
            raise ValueError("unknown delimiter or order")
        if set(self.columns) - set(S.ROLES) or len(set(self.columns.values())) != len(self.columns) or any(isinstance(i, bool) or not isinstance(i, int) or i < 0 for i in self.columns.values()):
            raise ValueError("columns map known roles to different places")
        if self.columns and (not {"frequency", "zreal", "zimag"} <= set(self.columns) or self.delimiter == "auto"):
            raise ValueError("declared columns need frequency, zreal and zimag, and a delimiter")
        if self.headerless and (not self.columns or self.header_row is not None or "auto" in (self.frequency_unit, self.impedance_unit, self.imag_convention)):
            raise ValueError("without a header, columns, units and the sign's convention must be declared")
        if self.header_row is not None and self.header_row < 1:
            raise ValueError("header rows count from one")


def _decode(contents: pd.Series) -> pd.Series:
    def one(raw: bytes | None) -> str | None:
        for name in ENCODINGS:
            try:
                return bytes(raw).decode(name) if raw is not None else None
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(one)


def decoded(content: Column) -> Column:
    """The text of a file: UTF-8 (with or without its mark) inside the JVM; only what is not goes to Python for other encodings."""
    text = content.cast("string")
    other = F.pandas_udf(_decode, "string")
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(other(F.when(~F.is_valid_utf8(text), content))), "^﻿", "")


def _fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line; quotes hold delimiters in."""
    quoted = F.transform(F.split(line, F.concat(delimiter, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)'))), lambda x: F.regexp_replace(F.regexp_replace(x, '^\\s*"(.*)"\\s*$', "$1"), '""', '"'))
    spaced = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    return F.when(delimiter == "whitespace", spaced).when(line.contains('"'), quoted).otherwise(F.split(line, delimiter))


def parse(files: DataFrame, layout: Layout = Layout()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, ledger, points) of text files (path, source_uid, source_sha256, content).

    files: path, source_uid, header, delimiter, status, error. ledger: source_uid, source_line, raw_line, status, reason. points:
    spectrum_uid, spectrum_id, source_uid, source_line, i, frequency_hz, zreal, neg_zimag, basis, acquisition_index, acquisition_time,
    time_unit (`s` where the header names a unit, else `raw`; null without such a column).
    """
    # A file's last line break ends a line and begins none.
    lines = F.split(F.regexp_replace(decoded(F.col("content")), r"(?:\r\n|\n|\r)$", ""), r"\r\n|\n|\r")
    base = files.select("path", "source_uid", "source_sha256", lines.alias("lines"))
    marks = [DELIMITERS[layout.delimiter]] if layout.delimiter != "auto" else list(DELIMITERS.values())
    if layout.columns:
        row = F.lit(layout.header_row or 1)
        header = _fields(F.get("lines", row - 1), F.lit(marks[0]))
        at = {r: F.lit(layout.columns[r]) if r in layout.columns else F.lit(None).cast("int") for r in S.ROLES}
        best = F.struct(F.lit(9).alias("score"), F.lit(marks[0]).alias("delimiter"), (F.lit(0) if layout.headerless else row).alias("row"), header.alias("header"), *[at[r].alias(r) for r in S.ROLES], F.array().cast("array<string>").alias("twice"))
    else:
        # Every mark and line is scored by the roles that its fields name; the first of equals wins.
        def look(m: Column) -> Column:
            mark, rank = m["mark"], m["rank"]

            def one(line: Column, i: Column) -> Column:
                return S.let(_fields(line, mark), lambda header: S.let(F.transform(header, lambda x: F.coalesce(S.header_role(x), F.lit(""))), lambda roles: scored(header, roles, i)))

            def scored(header: Column, roles: Column, i: Column) -> Column:
                place = [F.array_position(roles, r) - 1 for r in S.ROLES]
                n = sum((F.when(p >= 0, 1).otherwise(0) for p in place[1:]), F.when(place[0] >= 0, 1).otherwise(0))
                whole = (place[0] >= 0) & (place[1] >= 0) & (place[2] >= 0)
                twice = F.array_compact(F.array(*[F.when(F.size(F.array_remove(roles, r)) < F.size(roles) - 1, F.lit(r)) for r in S.ROLES]))
                return F.struct((n + F.when(whole, 6).otherwise(0)).alias("score"), (-rank).alias("rank"), (-i).alias("line"), mark.alias("delimiter"), (i + 1).alias("row"), header.alias("header"), *[F.when(p >= 0, p).cast("int").alias(r) for p, r in zip(place, S.ROLES)], twice.alias("twice"))

            return F.transform(F.slice("lines", 1, LOOK), one)

        found = F.flatten(F.transform(F.array(*[F.struct(F.lit(m).alias("mark"), F.lit(k).alias("rank")) for k, m in enumerate(marks)]), look))
        if layout.header_row:
            found = F.filter(found, lambda c: c["row"] == layout.header_row)
        best = F.array_max(found)
    f = base.withColumn("h", best)
    name = lambda role: F.get(F.col("h.header"), F.col(f"h.{role}"))
    zr, zi = S.impedance_scale(name("zreal"), layout.impedance_unit), S.impedance_scale(name("zimag"), layout.impedance_unit)
    f = f.withColumns({"ff": S.frequency_scale(name("frequency"), layout.frequency_unit), "zr": zr, "zi": zi, "sign": S.imaginary_sign(name("zimag"), layout.imag_convention), "ft": S.time_scale(name("time"))})
    missing = F.col("h.frequency").isNull() | F.col("h.zreal").isNull() | F.col("h.zimag").isNull()
    numeric = S.finite_double(name("frequency")).isNotNull() & S.finite_double(name("zreal")).isNotNull() & S.finite_double(name("zimag")).isNotNull()
    error = (
        F.when(F.col("lines").isNull(), "unreadable-encoding").when(F.col("h").isNull() | missing, "no-impedance-header").when(F.size("h.twice") > 0, "ambiguous-columns")
        .when(F.lit(bool(layout.columns) and not layout.headerless) & numeric, "declared-header-is-numeric").when(F.col("ff").isNull(), "ambiguous-frequency-unit")
        .when(F.col("zr").isNull() | F.col("zi").isNull(), "ambiguous-impedance-unit").when(F.col("zr.basis") != F.col("zi.basis"), "incompatible-units").when(F.col("sign").isNull(), "ambiguous-imaginary-sign")
    )
    f = f.withColumn("error", error)
    each = f.select("path", "source_uid", "source_sha256", "h", "ff", "ft", "zr", "zi", "sign", "error", F.posexplode_outer("lines").alias("_l", "raw_line")).withColumn("source_line", F.col("_l") + 1)
    data = F.col("error").isNull() & (F.col("source_line") > F.col("h.row"))
    odd = (F.col("h.delimiter") != "whitespace") & ((F.length("raw_line") - F.length(F.replace(F.col("raw_line"), F.lit('"'), F.lit("")))) % 2 == 1)
    each = each.withColumn("raw_fields", F.when(data, _fields(F.col("raw_line"), F.col("h.delimiter"))))
    mapping = {r: F.col(f"h.{r}") for r in ("frequency", "zreal", "zimag", "valid")}
    each = each.withColumn("reason", F.when(data, exclusion_reason(F.col("raw_fields"), mapping, F.col("ff"), F.col("zr.factor"), F.col("zi.factor"), odd)))
    status = F.when(F.col("error").isNotNull(), "unparsed").when(F.col("source_line") < F.col("h.row"), "preamble").when(F.col("source_line") == F.col("h.row"), "header").when(F.col("reason").isNull(), "included").otherwise("excluded")
    each = each.withColumn("status", status)
    value = lambda role: S.finite_double(F.get("raw_fields", F.col(f"h.{role}")))
    points = each.where("status = 'included'").select(
        "path", "source_uid", "source_sha256", "source_line", (value("frequency") * F.col("ff")).alias("frequency_hz"), (value("zreal") * F.col("zr.factor")).alias("zreal"),
        (value("zimag") * F.col("zi.factor") * F.col("sign")).alias("neg_zimag"), F.col("zr.basis").alias("basis"),
        F.when(F.col("h.index").isNull(), F.col("source_line").cast("double")).otherwise(value("index")).alias("acquisition_index"),
        (value("time") * F.coalesce("ft", F.lit(1.0))).alias("acquisition_time"), F.when(F.col("h.time").isNotNull(), F.when(F.col("ft").isNull(), "raw").otherwise("s")).alias("time_unit"),
    )
    if layout.order == "acquisition":
        runs, order = sweep_runs(points, "path", "source_line", "frequency_hz"), F.col("source_line")
    else:
        # Equal frequencies may be several sweeps: such a file keeps no points.
        w = Window.partitionBy("path")
        runs = points.withColumns({"run": F.lit(1), "_d": F.size(F.collect_set("frequency_hz").over(w)), "_n": F.count(F.lit(1)).over(w)}).where("_d = _n").drop("_d", "_n")
        order = F.desc("frequency_hz")
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    runs = runs.withColumn("spectrum_id", F.concat(stem, F.lit(":text:run"), F.col("run").cast("string")))
    runs = runs.withColumn("spectrum_uid", S.spectrum_uid(F.col("source_uid"), F.col("source_sha256"), F.col("spectrum_id")))
    runs = runs.withColumn("i", F.row_number().over(Window.partitionBy("spectrum_uid").orderBy(order)) - 1)
    points = runs.select("spectrum_uid", "spectrum_id", "source_uid", "source_line", "i", "frequency_hz", "zreal", "neg_zimag", "basis", "acquisition_index", "acquisition_time", "time_unit")
    some = points.select("source_uid").distinct().withColumn("_some", F.lit(True))
    out = f.join(some, "source_uid", "left").select("path", "source_uid", F.col("h.header").alias("header"), F.col("h.delimiter").alias("delimiter"), F.when(F.col("error").isNull() & F.col("_some"), "parsed").otherwise("failed").alias("status"), F.coalesce("error", F.when(F.col("_some").isNull(), "no-valid-points")).alias("error"))
    ledger = each.where("raw_line IS NOT NULL").select("source_uid", "source_line", "raw_line", "status", F.when(F.col("status") == "included", "valid-eis-row").otherwise(F.coalesce("reason", "error", "status")).alias("reason"))
    return out, ledger, points
