"""Every operator and stage on nulls, empty and long texts, repeats, clashing columns, and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ohmtide.llm import chunks, countjoin, decontam, ledger, lookup, mixing, packing, surrogates, tokencount, warc
from ohmtide.llm.common import scratch_path
from tests.llm.data import ODD, none, odd

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def bench(spark):
    return spark.createDataFrame([(1, "and here same line here and here same line here and"), (2, None), (3, ""), (4, "one"), (None, "two words")], "item_id bigint, text string")


OPERATORS = {
    "warc": lambda s, d: warc.read_archives(warc.write_archives(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "n"), warc.archive_folder(s))),
    "mixing": lambda s, d: mixing.score(d),
    "surrogates": lambda s, d: surrogates.replace(d, "k"),
    "ledger": lambda s, d: ledger.apply_policy(ledger.evaluate(d), "web-1"),
    "chunks": lambda s, d: chunks.dedup_lines(d),
    "countjoin": lambda s, d: countjoin.similar(d),
    "decontam": lambda s, d: decontam.find(d, bench(s)),
    "lookup": lambda s, d: lookup.place(d, "doc_id", ["a", "b", "c"], 101),
    "tokencount": lambda s, d: tokencount.count_tokens(d, scratch_path(s, "cache"), TOKENIZER),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_in_rows_out(spark, name):
    assert len(OPERATORS[name](spark, odd(spark)).collect()) == len(ODD)
    assert OPERATORS[name](spark, none(spark)).collect() == []


def test_packing(spark):
    got = packing.pack(odd(spark), TOKENIZER, 64).toPandas()
    assert (got.start == 0).sum() == len(ODD) and got.length.between(1, 64).all()
    assert packing.pack(none(spark), TOKENIZER).collect() == []


def test_empty_benchmark(spark):
    got = decontam.find(odd(spark), bench(spark).limit(0)).toPandas()
    assert len(got) == len(ODD) and (got.n_hit == 0).all()


def test_short_items_hit(spark):
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontam.find(odd(spark), bench(spark)).collect()}
    assert got[3] == (1, ["4"]) and got[4] == (1, ["4"]) and got[2] == (0, []) and got[7][0] > 10


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, tmp_path, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd(spark), none(spark)):
        got = stage[1](spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert got.count() <= docs.count()


def test_whole_texts_and_nulls_have_defined_results(spark):
    counts = {r.doc_id: r for r in countjoin.similar(odd(spark)).collect() if r.doc_id is not None}
    assert counts[1].n_shingles == 0 and counts[1].component_id == 1 and counts[3].component_id == 3 and counts[4].component_id == 3
    removed = [r for r in chunks.dedup_lines(odd(spark)).collect() if r.doc_id == 7]
    assert len(removed) == 2 and removed[0] == removed[1] and removed[0].removed_chunks > 0
    kept = {r.doc_id for r in ledger.keep(odd(spark), "base-1").collect()}
    assert kept == set()
    one = countjoin.one_of_each(odd(spark)).toPandas()
    assert (one.doc_id == 7).sum() == 1 and (one.doc_id == 3).sum() == 1 and (one.doc_id == 4).sum() == 0
