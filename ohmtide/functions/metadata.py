"""Canonical metadata: alias folding, decimal text, condition keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------------------------------------
ALIASES = {
    "temperature_c": "temperature_C", "protocol": "protocol_id", "amplitude_mv": "ac_amplitude_mv", "perturbation_mv": "ac_amplitude_mv",
    "rest_before_eis_s": "rest_time_s", "ocv_rest_s": "rest_time_s", "hold_time_s": "rest_time_s", "potential_v": "voltage_v",
}
NUMERIC = ("temperature_C", "ac_amplitude_mv", "rest_time_s", "voltage_v", "target_voltage_v", "cycle")
STATE_FIELDS = ("soc_percent", "state", "voltage_v")
IDENTITY_FIELDS = ("cell_id", "sample_id")
SIGNATURE_FIELDS = ("cell_id", "sample_id", "soc_percent", "state", "voltage_v", "temperature_C", "cycle", "direction", "protocol_id", "ac_amplitude_mv", "rest_time_s", "pressure_mpa", "data_origin", "impedance_basis")
VARIED = {"repeat": ("replicate",), "linearity": ("ac_amplitude_mv", "replicate"), "stationarity": ("rest_time_s", "replicate")}
CONDITION_FIELDS = ("cell_id", "sample_id", "state", "temperature_C", "cycle", "direction", "protocol_id", "ac_amplitude_mv", "rest_time_s")
# ---------------------------------------------------------------------------------------------------------------------------


def decimal_text(text: Column) -> Column:
    """A number's plain decimal form, without trailing zeros; null where the text is none."""
    number = F.trim(text).try_cast("decimal(38,12)")
    plain = F.regexp_replace(number.cast("string"), r"(?<=\d)(?:\.0+|(\.\d*?[1-9])0+)$", "$1")
    return F.when(number == 0, "0").otherwise(plain)


def entries(rows: DataFrame, key: str, metadata: str) -> DataFrame:
    """(key, name, value) for each non-blank entry of a map column, its name canonical and numbers in decimal form.

    A numeric field that is no number keeps no value, but for `cycle`, whose text stays.
    """
    each = rows.select(key, F.explode(metadata).alias("name", "value")).where(F.trim("value") != "")
    name = F.col("name")
    for alias, canonical in ALIASES.items():
        name = F.when(F.col("name") == alias, canonical).otherwise(name)
    each = each.select(key, name.alias("name"), F.trim("value").alias("raw"))
    number = decimal_text(F.col("raw"))
    value = F.when(F.col("name") == "cycle", F.coalesce(number, "raw")).when(F.col("name").isin(*NUMERIC), number).otherwise(F.col("raw"))
    return each.select(key, "name", "raw", value.alias("value"))


def canonical(rows: DataFrame, key: str, metadata: str) -> DataFrame:
    """One row a key: canonical (map), conflicts and invalid (names in order). Names with conflicting values are in no map.

    target_voltage_v stands for voltage_v where that is missing.
    """
    each = entries(rows, key, metadata)
    by_name = each.groupBy(key, "name").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"), F.count_if(F.col("value").isNull()).alias("bad"))
    folded = by_name.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("n") == 1) & (F.col("bad") == 0), F.struct("name", "value"))))).alias("canonical"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("name")))).alias("conflicts"),
        F.sort_array(F.collect_list(F.when(F.col("bad") > 0, F.col("name")))).alias("invalid"),
    )
    target = F.col("canonical")["target_voltage_v"]
    fill = target.isNotNull() & F.col("canonical")["voltage_v"].isNull()
    return folded.withColumn("canonical", F.when(fill, F.map_concat("canonical", F.map_from_arrays(F.array(F.lit("voltage_v")), F.array(target)))).otherwise(F.col("canonical")))


def condition_key(meta: Column, basis: Column, role: Column, origin: Column, source: Column) -> Column:
    """What spectra must share to be of one condition. Without a cell or sample they are of their source alone."""
    known = meta["cell_id"].isNotNull() | meta["sample_id"].isNotNull()
    fields = [F.concat(F.lit(f"{k}="), F.coalesce(meta[k], F.lit(""))) for k in CONDITION_FIELDS]
    return F.concat_ws("|", *fields, F.when(known, F.lit("")).otherwise(F.concat(F.lit("source="), source)), basis, role, origin)


def group_id(meta: Column, purpose: str) -> Column:
    """The control group of a spectrum for a purpose; null unless it has a state and a cell or sample. A name given explicitly
    only goes before what must match, and never overrides it."""
    some = lambda names: F.coalesce(*[F.when(meta[n] != "", meta[n]) for n in names]).isNotNull()
    parts = [F.when(meta[k] != "", F.concat(F.lit(f"{k}="), meta[k])) for k in SIGNATURE_FIELDS if k not in VARIED[purpose]]
    named = F.coalesce(F.when(meta[f"{purpose}_group"] != "", meta[f"{purpose}_group"]), F.when(meta["state_group"] != "", meta["state_group"]))
    return F.when(some(STATE_FIELDS) & some(IDENTITY_FIELDS), F.concat_ws("|", F.when(named.isNotNull(), F.concat(F.lit("explicit:"), named)), *parts))
