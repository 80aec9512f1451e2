"""Which rows of a text table are observations, and for the others the one reason why not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ohmtide.functions.scalars import finite, finite_double


def exclusion_reason(fields: Column, mapping: dict[str, int | Column], frequency_factor: float | Column, real_factor: float | Column, imaginary_factor: float | Column, parse_error: Column | None = None) -> Column:
    """Null for an observation, else the first reason that holds, in the order in which they are written here.

    `mapping` has the place of each role; where that of `valid` is null, the table has no such column and every row counts.
    """
    place = {r: F.lit(i) if isinstance(i, int) else i for r, i in mapping.items()}
    of = lambda role: finite_double(F.get(fields, place[role]))
    blank = F.coalesce(F.size(fields) <= 0, F.lit(True)) | ~F.exists(fields, lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    short = F.size(fields) <= F.greatest(*(place[r] for r in ("frequency", "zreal", "zimag")))
    f, re, im = of("frequency"), of("zreal"), of("zimag")
    valid = F.when(place["valid"].isNull(), F.lit(1.0)).otherwise(of("valid")) if "valid" in place else F.lit(1.0)
    scaled = [finite(x * factor) for x, factor in ((f, frequency_factor), (re, real_factor), (im, imaginary_factor))]
    return (
        F.when(parse_error if parse_error is not None else F.lit(False), "csv_parse_error").when(blank, "blank_row").when(short, "short_row")
        .when(valid.isNull(), "invalid_valid_flag").when(valid <= 0, "Valid=0")
        .when(f.isNull() | re.isNull() | im.isNull(), "nonnumeric_or_nonfinite")
        .when(scaled[0].isNull() | scaled[1].isNull() | scaled[2].isNull(), "nonfinite_after_unit_conversion")
        .when(scaled[0] <= 0, "nonpositive_frequency")
    )
