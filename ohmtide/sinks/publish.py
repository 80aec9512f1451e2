"""Tables out: CSV for people, Parquet under a run's fingerprint for machines, and a manifest of what a run has published."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.functions.scalars import finite, spreadsheet_safe


def without_nonfinite(df: DataFrame) -> DataFrame:
    """Doubles that are not finite as nulls."""
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def flat(df: DataFrame, safe: bool = True) -> DataFrame:
    """Nested columns as JSON text; text that a spreadsheet would run gets an apostrophe."""
    df = without_nonfinite(df)
    nested = lambda t: t.startswith(("struct", "array", "map"))
    return df.select(*[F.to_json(c).alias(c) if nested(t) else spreadsheet_safe(F.col(c)).alias(c) if safe and t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; `single` is for small tables that a person opens: it brings all rows to one task."""
    (flat(df).coalesce(1) if single else flat(df)).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    without_nonfinite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def fingerprint(options: dict, inputs: DataFrame) -> str:
    """A run's identity: its options, and the contents of its inputs in any order."""
    digest = inputs.select(F.bit_xor(F.xxhash64("source_uid", "source_sha256")), F.count(F.lit(1))).first()
    return hashlib.sha256(json.dumps([options, list(digest)], sort_keys=True).encode()).hexdigest()[:24]


def _plain_name(name: str) -> str:
    """A name that is one part of a path, and none of our own (which begin with an underscore)."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
        raise ValueError(f"{name!r} can't name a published run or table")
    return name


class _Folder:
    """A folder on the file system that its path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.path = spark, folder.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, name: str):
        return self.path(f"{self.folder}/{name}")

    def has(self, name: str) -> bool:
        return self.fs.exists(self.of(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.of(name))) if self.has(name) else []

    def make(self, name: str) -> None:
        """An empty file that must not be there yet."""
        self.fs.mkdirs(self.of(name).getParent())
        self.fs.create(self.of(name), False).close()


def contents(df: DataFrame) -> DataFrame:
    """One row (rows, digest) of a table: digest is the sum of its rows' hashes, so order and files don't matter but repeats do."""
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in sorted(df.dtypes)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


def published(spark: SparkSession, folder: str, run: str) -> bool:
    return _Folder(spark, folder).has(f"{_plain_name(run)}/_manifest/_SUCCESS")


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, run: str, partition: dict[str, str] | None = None, owner: str = "analysis") -> DataFrame:
    """Publishes a run's tables as folder/run/name and returns its manifest (name, owner, rows, digest): readers take only runs that have one.

    All tables are written and read back in a staging folder first, which then becomes folder/run in one rename; a failure before
    leaves nothing of the run behind, and earlier runs as they were. A run that is published is not written again. Runs are never
    overwritten: the last one is `current`, the others stay as they are. A folder run/ without a manifest is not ours and is refused.
    Two publications of one owner don't overlap: the second finds the lock and raises; a lock that a lost driver left behind is an
    empty file, _lock-owner, to be deleted by hand. The file system must rename folders in one step, as HDFS does.
    """
    at = _Folder(spark, folder)
    for name in (run, owner, *tables):
        _plain_name(name)
    if not published(spark, folder, run):
        lock, stage = f"_lock-{owner}", f"_staging-{run}-{uuid.uuid4().hex}"
        try:
            at.make(lock)
        except Py4JJavaError as e:
            raise RuntimeError(f"{folder}/{lock} is there: another publication is in progress") from e
        try:
            if at.has(run):
                raise FileExistsError(f"{folder}/{run} was not published here")
            rows = []
            for name, df in tables.items():
                writer = df.withColumn("run_fingerprint", F.lit(run)).write
                by = (partition or {}).get(name)
                (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{stage}/{name}")
                rows.append((name, owner, *contents(spark.read.parquet(f"{folder}/{stage}/{name}")).first()))
            spark.createDataFrame(rows, "name string, owner string, rows bigint, digest string").coalesce(1).write.parquet(f"{folder}/{stage}/_manifest")
            if not at.fs.rename(at.of(stage), at.of(run)):
                raise OSError(f"{folder}/{run} could not be put in place")
            at.make(f"_history-{owner}/{len(at.names(f'_history-{owner}')):09d}.{run}")
        finally:
            at.fs.delete(at.of(stage), True)
            at.fs.delete(at.of(lock), False)
    return spark.read.parquet(f"{folder}/{run}/_manifest")


def current(spark: SparkSession, folder: str, owner: str = "analysis") -> str | None:
    """The owner's last published run; those before it are superseded."""
    runs = _Folder(spark, folder).names(f"_history-{owner}")
    return runs[-1].split(".", 1)[1] if runs else None


def changed(spark: SparkSession, folder: str, run: str) -> list[str]:
    """Names of a run's tables whose contents are no longer those that were published."""
    found = []
    for row in spark.read.parquet(f"{folder}/{_plain_name(run)}/_manifest").collect():
        here = contents(spark.read.parquet(f"{folder}/{run}/{row['name']}")).first()
        found += [row["name"]] * ((here["rows"], here["digest"]) != (row["rows"], row["digest"]))
    return found
