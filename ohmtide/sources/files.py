"""Source files: discovery, identities, the manifest, and what to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.functions.scalars import source_uid
from ohmtide.operators.tables import manifest_faults, row_selected

# --- fixed values: what files are, by suffix -------------------------------------------------------------------------------
TEXT = (".csv", ".txt", ".tsv")
CONTAINER = (".irf",)
VENDOR = (".dfr", ".dta", ".i2b", ".idf", ".ids", ".mpr", ".mpt", ".p00", ".pssession", ".z", ".xlsx")
# ---------------------------------------------------------------------------------------------------------------------------


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def discover(spark: SparkSession, paths: list[str], exclude: str | None = None) -> DataFrame:
    """path, suffix, source_uid, source_sha256, content of all supported files, each once; an empty set is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    files = files.select("path", suffix(F.col("path")).alias("suffix"), source_uid(F.col("path")).alias("source_uid"), F.sha2("content", 256).alias("source_sha256"), "content")
    files = files.where(F.col("suffix").isin(*TEXT, *CONTAINER, *VENDOR))
    if exclude:
        files = files.where(~F.col("path").startswith(exclude))
    files = files.dropDuplicates(["path"])
    if files.select("path").isEmpty():
        raise ValueError(f"no supported files in {paths}")
    return files


def looks_generated(content: Column) -> Column:
    """Whether a file's first 16 KiB name columns of results (a distribution's, or a potential over time) and not of impedance."""
    head = F.lower(F.try_validate_utf8(F.substring(content, 1, 16384).cast("string")))
    result = head.rlike(r"(?m)^[^\n]*\b(?:tau_s|gamma)\b[^\n]*\b(?:gamma|tau_s)\b") | head.contains("spectrum_uid")
    potential = head.rlike(r"(?m)^\W*time[^\n]*(?:voltage|potential|ocp|ocv)") & ~head.rlike("freq")
    return F.coalesce(result | potential, F.lit(False))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV, all columns as text; blank or repeated columns, blank paths and repeated keys are errors."""
    with_names = spark.read.option("header", "false").csv(path).limit(1).first()
    names = [(c or "").strip() for c in with_names] if with_names else []
    if "path" not in names or "" in names or len(set(names)) != len(names):
        raise ValueError("a manifest needs distinct, named columns, and `path` among them")
    rows = spark.read.option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    if "spectrum_id" not in rows.columns:
        rows = rows.withColumn("spectrum_id", F.lit(None).cast("string"))
    faults = manifest_faults(rows, "path", "spectrum_id").limit(5).collect()
    if faults:
        raise ValueError(f"manifest: {[(r.fault, r.path, r.spectrum_id) for r in faults]}")
    return rows


def inventory(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """path, source_uid, source_sha256, input_role, selected, selection_reason; paths of the manifest without a file are rows too."""
    base = files.select("path", "source_uid", "source_sha256", looks_generated(F.col("content")).alias("generated"))
    if manifest is None:
        return base.select("path", "source_uid", "source_sha256", F.lit(None).cast("string").alias("input_role"), (~F.col("generated")).alias("selected"), F.when(F.col("generated"), "generated-or-not-impedance").otherwise("discovered").alias("selection_reason"))
    columns = {c: F.col(c) if c in manifest.columns else F.lit(None).cast("string") for c in ("include", "input_role")}
    own = manifest.select("path", columns["include"].alias("include"), columns["input_role"].alias("input_role")).groupBy("path").agg(F.bool_or(row_selected(F.col("include"), F.col("input_role"))).alias("taken"), F.max("input_role").alias("input_role"))
    joined = base.join(own, "path", "full_outer")
    reason = (
        F.when(F.col("source_uid").isNull(), "requested-but-missing").when(F.col("taken").isNull(), "not-in-manifest")
        .when(~F.col("taken"), "excluded-by-manifest").otherwise("manifest")
    )
    return joined.select("path", "source_uid", "source_sha256", "input_role", F.coalesce(F.col("taken") & F.col("source_uid").isNotNull(), F.lit(False)).alias("selected"), reason.alias("selection_reason"))
