"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage reads the table that the one before has written, so a lost executor costs at most the stage's own tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.llm import chunks, countjoin, decontam, ledger, packing
from ohmtide.llm.common import drop_written, quoted, scratch_path

POLICY = "web-1"
TOKENIZER = "byte_bpe_50k.json"
#: What line dedup counts, under names that no table has.
REMOVED = ("ohmtide_removed_chunks", "ohmtide_removed_lines")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps, with all their columns. Null, empty and short texts have too few words, and go; repeated rows
    stay or go alike, with or without a doc_id; an empty table gives none; long texts are judged whole."""
    return ledger.keep(docs, POLICY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated chunks; n_chars follows the text.

    A document all of whose words occur in earlier ones is a copy, and goes. Null and empty texts, which lose nothing, stay, as do
    rows without a doc_id unless they are left empty; repeated rows stay or go alike; an empty table gives none; other columns may
    have any names, n_chars none at all.
    """
    done = chunks.dedup_lines(docs, names=REMOVED).where((F.col(REMOVED[0]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return done.select(*[F.when(F.col(REMOVED[0]) > 0, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect: that of the smallest doc_id. Null and empty texts, and rows
    without a doc_id, are linked with nothing and stay; of rows that share a doc_id one stays; an empty table gives none; long texts
    are compared whole; other columns may have any names."""
    return countjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs, with all their columns. Null and empty texts have no words, and stay, as
    do all documents where the benchmark is empty; repeated rows stay or go alike, with or without a doc_id."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in their sequences. A null or empty text is its end id alone; repeated rows, and rows without a
    doc_id, are packed each; an empty table gives none; long texts are cut into pieces, and nothing of them is left out."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer, so it can't express the last stage; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`. Each stage's table is deleted when the next one's is written; the last one's input is
    read by the result, and stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_written(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
