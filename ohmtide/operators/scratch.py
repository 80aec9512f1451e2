"""Tables and files that a run keeps between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str = "files") -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local one, which only a session on one machine can share; on a
    cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ohmtide-')}"
    return f"{found.rstrip('/')}/ohmtide-{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """`rows`, computed once into a table of the scratch folder: what is read of it several times is not computed again, nor lost with
    an executor."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
