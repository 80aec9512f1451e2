"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of an item (or the whole item, if shorter); a document is hit where a window occurs in it.
Window and document are compared as sets of shingles with their positions. As the whole window must be contained, one shingle of
it is a sufficient prefix: the rarest, by the order of counts over all windows. Shingles of documents that are no window's
prefix are dropped inside the scan by a bit table of fixed size; the others join the windows that have them as their prefix, the
position of the prefix and both lengths bound where the window can begin, and the words there are compared. Built-in expressions
only: no Python runs on executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.common import BROADCAST_ROWS, join_small, quoted, written
from ohmtide.llm.native import let, lower, positions

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 5
#: Most bits of the table that drops shingles early (128 KB). A fuller table only lets more candidates through.
MOST_BITS = 1 << 20


def item_words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering A-Z; null has none."""
    return F.array_remove(F.split(lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """The distinct windows: `window` (words joined by spaces), k (words), item_ids, prefix (its rarest shingle), prefix_at."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = positions(F.greatest(F.size("w") - size + 1, F.lit(1)))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("window_words"))
    windows = windows.groupBy("window_words").agg(F.collect_set("item_id").alias("item_ids"))
    each = windows.select(
        "window_words", "item_ids", F.size("window_words").alias("k"),
        F.posexplode(F.transform(positions(F.greatest(F.size("window_words") - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice("window_words", i + 1, SHINGLE), " "))).alias("prefix_at", "prefix"),
    )
    counts = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "prefix").groupBy("window_words").agg(F.min(F.struct("n", "prefix", "prefix_at")).alias("p"), F.first("item_ids").alias("item_ids"), F.first("k").alias("k"))
    return rarest.select(F.array_join("window_words", " ").alias("window"), "k", "item_ids", "p.prefix", "p.prefix_at")


def bit_table(prefixes: DataFrame, hashed: Column, bits: int) -> list[int]:
    """Which hashes, modulo `bits`, occur: 64 to a number. At most bits / 64 rows come to the driver."""
    slot = hashed.bitwiseAND(F.lit(bits - 1))
    # 1 << 63 is the sign bit, so the numbers are built by or.
    rows = prefixes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).collect()
    table = [0] * (bits // 64)
    for at, b in rows:
        table[at] = b
    return table


def find(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row for each row of `documents`: doc_id, text_hash (xxhash64, which tells rows of one doc_id apart), n_words, spans (hit words as struct<at, length>, one for each place where a
    window occurs), n_hit (words inside any of them), item_ids (sorted as strings).

    Null and empty texts have no words and no hits, items without words have no windows; a null item_id hits but is not listed;
    repeated rows are each searched; empty tables give no rows, or rows without hits. Only doc_id, item_id and text are read.
    """
    windows = written(windows_of(benchmark, size), "windows")
    widths = {}
    n_windows = 0
    for k, n in windows.groupBy(F.least("k", F.lit(SHINGLE)).alias("width")).count().collect():  # at most SHINGLE rows
        widths[k], n_windows = n, n_windows + n
    bits = min(MOST_BITS, 1 << max(16 * n_windows, 64).bit_length())
    reach = max(size - SHINGLE, 0)

    def spot(w: Column, i: Column, width: int) -> Column:
        return F.xxhash64(*[w[i + j] for j in range(width)])

    tables = {}
    for width in sorted(widths):
        own = windows.where(F.least("k", F.lit(SHINGLE)) == width).select(F.split("prefix", " ").alias("w"))
        tables[width] = F.lit(np.array(bit_table(own, F.xxhash64(*[F.col("w")[j] for j in range(width)]), bits), np.int64))

    def of_width(w: Column, width: int) -> Column:
        def known(i: Column) -> Column:
            return let(spot(w, i, width).bitwiseAND(F.lit(bits - 1)), lambda b: F.getbit(F.get(tables[width], F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int"))) == 1

        def around(i: Column) -> Column:
            low = F.greatest(i - reach, F.lit(0))
            return F.struct(i.alias("at"), low.alias("low"), F.array_join(F.slice(w, i + 1, width), " ").alias("prefix"), F.slice(w, low + 1, i - low + width + reach).alias("around"))

        return F.transform(F.filter(positions(F.size(w) - width + 1), known), around)

    def candidates(w: Column) -> Column:
        lists = [of_width(w, width) for width in sorted(widths)]
        return F.concat(*lists) if lists else F.array().cast("array<struct<at:int,low:int,prefix:string,around:array<string>>>")

    looked = let(item_words(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), candidates(w).alias("c")))
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), looked.alias("x"))
    rows = rows.select("doc_id", "text_hash", "row", "x.n_words", F.explode_outer("x.c").alias("c")).select("doc_id", "text_hash", "row", "n_words", "c.*")
    # A window's row has at most a few hundred bytes, mostly its words; beyond the bound both sides are shuffled.
    side = F.broadcast(windows) if 16 * n_windows <= BROADCAST_ROWS * 8 else windows.hint("merge")
    begin = F.col("at") - F.col("prefix_at")
    met = rows.join(side, "prefix", "left")
    occurs = (begin >= F.col("low")) & (begin + F.col("k") <= F.col("n_words")) & (F.array_join(F.slice("around", F.greatest(begin - F.col("low"), F.lit(0)) + 1, F.col("k")), " ") == F.col("window"))
    hit = met.select("doc_id", "text_hash", "row", "n_words", F.when(occurs, F.struct(begin.alias("at"), F.col("k").alias("length"))).alias("span"), F.when(occurs, F.col("item_ids")).alias("item_ids"))
    by_row = hit.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    return by_row.select("doc_id", "text_hash", "n_words", "spans", covered.cast("bigint").alias("n_hit"), F.sort_array(F.transform("ids", lambda x: x.cast("string"))).alias("item_ids"))


def remove(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `documents`, with all their columns (of any names), in which no window of the benchmark occurs. Null and empty texts
    stay; repeated rows stay or go alike; with an empty benchmark all stay; long texts are searched whole."""
    hits = written(find(documents, benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias("ohmtide_id"), F.col("text_hash").alias("ohmtide_th")).distinct(), "hits")
    keyed = documents.withColumn("ohmtide_text_hash", F.xxhash64("text"))
    return join_small(keyed, hits, hits.count(), F.expr("doc_id <=> ohmtide_id AND ohmtide_text_hash = ohmtide_th"), "left_anti").select(*[quoted(c) for c in documents.columns])
