"""Token counts through a digest cache.

A text's digest is the SHA-256 of its content as it is encoded (null as the empty text, else unchanged: any other normalisation
would change the ids), a tokenizer's that of its file. The cache is a Parquet table (text_digest, tokenizer_digest, n_tokens).
Documents join it by both; what is missing is encoded once for each distinct text and appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.common import drop_written, join_dealt, join_small, written
from ohmtide.llm.encoding import encoder, texts_of, tokenizer_digest

CACHE = "text_digest binary, n_tokens bigint, tokenizer_digest string"


def _cached(spark, cache_path: str, version: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    # A job that was run again after a failure may have appended a text twice.
    return rows.where(F.col("tokenizer_digest") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of `documents`, by the tokenizer file `tokenizer` (.json or .model).

    `cache_path` is in a folder that all executors share; it is made where missing, and what it has is not encoded again. Only
    doc_id and text are read. A null text counts as empty, with no tokens; a null doc_id is kept; repeated rows each come out, and
    their text is encoded once; an empty table gives no rows and appends none. Texts are encoded whole, in lots of about a million
    characters; very long ones and long runs of white space have the ids that the library gives them.
    """
    spark, version = documents.sparkSession, tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_digest"))
    sized = written(rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text_digest"), "token-rows")
    # Each text's first document, and how many rows say that they are it: a text is encoded where that one row lies.
    same = sized.groupBy("text_digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = same.groupBy("text_digest").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("n"))).alias("first"))
    texts = written(texts, "token-texts")
    missing = texts.join(_cached(spark, cache_path, version).select("text_digest"), "text_digest", "left_anti")
    missing = written(missing.select("text_digest", F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("alike")), "token-missing")
    # Rows not to encode: those of texts that the cache has, and copies. Mostly they are few, and the texts need no shuffle.
    m = missing.where("alike = 1").withColumnRenamed("text_digest", "m_digest")
    skip = same.select("doc_id", "text_digest").join(m, F.expr("text_digest = m_digest AND doc_id <=> first_id"), "left_anti")
    skip = written(skip.withColumnsRenamed({"text_digest": "s_digest", "doc_id": "s_id"}), "token-skip")
    todo = join_small(rows, skip, skip.count(), F.expr("text_digest = s_digest AND doc_id <=> s_id"), "left_anti").select("text_digest", "text")
    # Of rows that nothing tells apart, one text is taken.
    alike = missing.where("alike > 1").select("text_digest")
    n_alike = alike.count()
    if n_alike:
        todo = todo.unionByName(join_small(rows.select("text_digest", "text"), alike, n_alike, ["text_digest"], "left_semi").groupBy("text_digest").agg(F.min("text").alias("text")))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for at, lot in texts_of(batch.column(1)):
                counts[at : at + len(lot)] = [len(ids) for ids in own.encode(lot)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["text_digest", "n_tokens"])

    new = todo.mapInArrow(encoded, "text_digest binary, n_tokens bigint")
    new.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").parquet(cache_path)
    for old in (missing, skip):
        drop_written(spark, old)
    return join_dealt(sized, _cached(spark, cache_path, version), texts.select("text_digest", F.col("n").alias("ohmtide_n")), ["text_digest"]).select("doc_id", "n_bytes", "n_tokens")
