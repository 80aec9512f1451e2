"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that its links reach) for each node of `links` (a, b: long).

    In each round every node goes over to the neighbour, or itself, of the smallest hash, where the hash changes with the round;
    links between nodes that went to different ones are what the next round has. Long chains shrink by a constant factor a round.
    Each round is written to the shared folder, and nothing but its count comes to the driver. No links, no rows.
    """
    spark = links.sparkSession
    edges = written(links.where("a <> b").distinct(), "cc-links")
    to = None  # node -> where it has gone
    round_ = 0
    while edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_), c), c.alias("n"))
        step = written(both.groupBy("a").agg(F.least(F.min(rank(F.col("b"))), F.first(rank(F.col("a"))))["n"].alias("p")), "cc-step")
        moved = step.withColumnsRenamed({"a": "x", "p": "y"})
        to_next = step.select(F.col("a").alias("node"), F.col("p").alias("root")) if to is None else to.join(moved, to["root"] == moved["x"], "left").select("node", F.coalesce("y", "root").alias("root"))
        to_next = written(to_next, "cc-to")
        next_edges = edges.join(moved, edges["a"] == moved["x"]).select(F.col("y").alias("a"), "b").join(moved, F.col("b") == moved["x"]).select("a", F.col("y").alias("b"))
        next_edges = written(next_edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
        for old in (edges, step, *([to] if to is not None else [])):
            drop_written(spark, old)
        edges, to, round_ = next_edges, to_next, round_ + 1
    if to is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    least = to.groupBy("root").agg(F.min("node").alias("component"))
    return to.join(least, "root").select("node", "component")
