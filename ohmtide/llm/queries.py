"""The queries of the training-data operators, with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.llm import chunks, countjoin, decontam, ledger, lookup, mixing, packing, surrogates, tokencount, warc
from ohmtide.llm.common import scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: In production, a secret of the run.
SURROGATE_KEY = "surrogates-1"
CACHE_SETTING = "spark.ohmtide.tokenCache"
SHARDS = [f"shard-{i:03d}" for i in range(200)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_read(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(_read(spark, sf_dir, "documents"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace(_read(spark, sf_dir, "documents"), SURROGATE_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return replaced.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), kinds.alias("kinds"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = ledger.store(_read(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    found = ledger.with_ablations(stored, "web-1")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*columns, (~ledger.passes("base-1")).alias("base_failed"), "kept", "failure_bits", "only_rule", "n_only", "n_kept_without")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chunks", "removed_lines")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.similar(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.place(_read(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache that outlives the run is named in the session; without one, the run begins with an empty cache of its own.
    cache = spark.conf.get(CACHE_SETTING, None) or scratch_path(spark, "token-cache")
    counted = tokencount.count_tokens(_read(spark, sf_dir, "documents"), cache, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_context_mixing, op3_surrogates, op4_rule_ledger, op5_line_chunks, op6_ngram_join, op7_decontaminate, op8_lookup_shards, op9_pack, op10_token_counts)}

SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS k, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT k, min(page_id) AS first_id FROM p GROUP BY k)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10))::UBIGINT >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (k)""",
    "op4_rule_ledger": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
s AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM s),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (n_words > 100000)::INT AS BIGINT) AS failure_bits FROM m),
o AS (SELECT *, CASE failure_bits & 31 WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'short_words' END AS only_rule FROM b),
a AS (SELECT only_rule, count(*) AS n_only, count(*) + (SELECT count(*) FROM b WHERE failure_bits & 31 = 0) AS n_kept_without FROM o WHERE only_rule IS NOT NULL GROUP BY only_rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits & 31 = 0 AS kept, failure_bits, only_rule, n_only, n_kept_without FROM o LEFT JOIN a USING (only_rule)""",
    "op5_line_chunks": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
h AS (SELECT r, doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM d),
o AS (SELECT r, l, n, h, doc_id, list_transform(range(1, len(l) + 1), lambda i: i = len(l) OR n[i] >= 8 OR coalesce(n[i + 1], 0) >= 8) AS own FROM h),
g AS (SELECT r, i AS i, own[i] AS own, h[i] AS h, coalesce(own[i - 1], true) AS fresh, h[i - 1] AS p FROM (SELECT r, h, own, unnest(range(1, len(l) + 1)) AS i FROM o)),
e AS (SELECT r, i AS e FROM g WHERE own OR (((31 * (CASE WHEN fresh THEN 0 ELSE p END) + 17 * h) % 4294967296) >> 7) % 2 = 0),
f AS (SELECT r, e, coalesce(lag(e) OVER w, 0) AS b, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY r ORDER BY e)),
c AS (SELECT r, doc_id, k, b, array_to_string(l[b + 1:e], chr(10)) AS chunk, list_sum(n[b + 1:e]) AS words, len(list_filter(n[b + 1:e], lambda x: x > 0)) AS lines FROM f JOIN o USING (r)),
u AS (SELECT r, doc_id, k, b, 1 AS size, chunk AS unit FROM c WHERE words >= 40
  UNION ALL SELECT * FROM (SELECT r, doc_id, k, b, 2 AS size, chunk || chr(10) || lead(chunk) OVER (PARTITION BY r ORDER BY k) AS unit FROM c) WHERE unit IS NOT NULL),
m AS (SELECT size, unit, min((doc_id, b)) AS first FROM u GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT DISTINCT r, unnest(range(k, k + u.size)) AS k FROM u JOIN m ON u.size = m.size AND u.unit = m.unit WHERE (doc_id, b) <> first),
i AS (SELECT r, k, words, lines, k - row_number() OVER (PARTITION BY r ORDER BY k) AS island FROM x JOIN c USING (r, k)),
z AS (SELECT r, k, lines FROM (SELECT *, sum(words) OVER (PARTITION BY r, island) AS run FROM i) WHERE run >= 40),
t AS (SELECT c.r, coalesce(string_agg(chunk, chr(10) ORDER BY c.k) FILTER (z.k IS NULL), '') AS text, count(z.k) AS removed_chunks, coalesce(sum(z.lines), 0)::BIGINT AS removed_lines FROM c LEFT JOIN z ON c.r = z.r AND c.k = z.k GROUP BY c.r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text, removed_chunks, removed_lines FROM d JOIN t USING (r)""",
    "op7_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
v AS (SELECT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
u AS (SELECT k, win, list(DISTINCT item_id) AS ids FROM v GROUP BY k, win),
p AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM u))),
m AS (SELECT r, s, p.k, ids FROM p JOIN u ON p.k = u.k AND p.win = u.win),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS j FROM m) GROUP BY r),
x AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM (SELECT r, unnest(ids) AS id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)""",
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)""",
}
