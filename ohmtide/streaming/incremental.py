"""Files that keep arriving: each micro-batch is parsed and appended, and a file is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ohmtide.functions.scalars import source_uid
from ohmtide.sources.files import TEXT, suffix
from ohmtide.sources.text import Layout, parse


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, layout: Layout = Layout()) -> StreamingQuery:
    """Parses what is in `folder` and not yet taken, appends files, ledger and points under `out`, and stops.

    A batch that is run again after a failure overwrites its own partition, so nothing is appended twice.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def take(batch: DataFrame, epoch: int) -> None:
        own = batch.where(suffix(F.col("path")).isin(*TEXT)).select("path", source_uid(F.col("path")).alias("source_uid"), F.sha2("content", 256).alias("source_sha256"), "content").persist()
        for name, table in zip(("files", "ledger", "points"), parse(own, layout)):
            table.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        own.unpersist()

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
