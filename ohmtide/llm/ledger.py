"""A ledger of quality rules: every rule is evaluated once for each document, and a policy is a mask over the failure bits.

The ledger keeps the measurements and a bit for each rule that fails. Policies are versioned sets of rules, so a new policy needs
no new look at the texts: a document is kept if the bits and the policy's mask have none in common. What each rule of a policy
contributes is found by bitwise aggregation over the (few) patterns of bits that occur. Built-in expressions only; one narrow pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.native import SPACES, let, positions, words

SYMBOLS = "#*$%&|<>"

#: Rules by name; a rule's bit is its place. Rules are only ever added at the end, so that stored bits keep their meaning.
RULES: dict[str, Callable[[Column], Column]] = {
    "too_few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "too_many_words": lambda m: m["n_words"] > 100_000,
}
#: Policies by version: the rules for which a document goes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_words"),
    "web-1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "short_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def repeated_words(tokens: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more in the text.

    Windows are compared by 64-bit hashes. Most texts have no repeated window, which one sort of the hashes shows; for the others
    the places of repeated windows are read off the sorted (hash, place) pairs.
    """

    def of(w: Column) -> Column:
        hashed = F.transform(positions(F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def among(h: Column) -> Column:
            def covered(z: Column) -> Column:
                n = F.size(z)
                at = F.transform(
                    F.filter(positions(n), lambda i: ((i > 0) & (F.get(z, i)["h"] == F.get(z, i - 1)["h"])) | ((i < n - 1) & (F.get(z, i)["h"] == F.get(z, i + 1)["h"]))),
                    lambda i: F.get(z, i)["i"],
                )
                return let(at, lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))))

            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

        return let(hashed, among)

    return let(tokens, of)


def ledger_of(text: Column) -> Column:
    """struct<MEASURES, failure_bits> (long) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    # Words are looked at twice, once to count them and once in their windows; the text is split once.
    stats = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    line_stats = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))

    def measured(w: Column) -> Column:
        return let(line_stats, lambda x: F.struct(
            w["n_words"].cast("bigint").alias("n_words"), F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"), x["n_lines"].cast("bigint").alias("n_lines"),
            x["n_dup_lines"].cast("bigint").alias("n_dup_lines"), w["n_repeat_words"].cast("bigint").alias("n_repeat_words"),
        ))

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("bigint")
        for name, rule in RULES.items():
            bits = bits.bitwiseOR(F.when(rule(m), F.lit(bit(name))).otherwise(F.lit(0)).cast("bigint"))
        return F.struct(*[m[k].alias(k) for k in MEASURES], bits.alias("failure_bits"))

    return let(let(stats, measured), judged)


def evaluate(documents: DataFrame) -> DataFrame:
    """The ledger: doc_id, MEASURES and failure_bits (long), one row for each row of `documents`.

    A null or empty text has no words and so fails too_few_words; repeated rows and null doc_ids each keep their row; an empty
    table gives an empty ledger; other columns are not read.
    """
    return documents.select("doc_id", ledger_of(F.col("text")).alias("ledger")).select("doc_id", "ledger.*")


def store(documents: DataFrame, path: str) -> DataFrame:
    """The ledger of `documents`, written to `path` and read back: what policies and ablations are applied to, without the texts."""
    evaluate(documents).write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def keep(documents: DataFrame, policy: str) -> DataFrame:
    """The rows of `documents`, with all their columns, that a policy keeps: one narrow pass, without a join.

    Null, empty and short texts fail too_few_words; repeated rows, and rows without a doc_id, stay or go by their text; an empty table
    gives none; texts of any length are judged whole."""
    return documents.where(ledger_of(F.col("text"))["failure_bits"].bitwiseAND(F.lit(mask(policy))) == 0)


def passes(policy: str) -> Column:
    """Whether a row of the ledger is kept under a policy."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    return ledger.withColumn("kept", passes(policy))


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, those that only it removes, and what would be kept without it.

    The ledger is first summed by pattern of bits, at most 2 to the number of rules, so no rule costs a pass of its own.
    all_fail_bits and any_fail_bits are the bitwise and and or over the documents that fail the rule: what always and what ever
    fails with it.
    """
    patterns = ledger.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("failure_bits").bitwiseAND(F.col("rule_bit")) != 0
    relevant = F.col("failure_bits").bitwiseAND(F.col("policy_mask"))
    each = patterns.withColumn("rule_row", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("bigint").alias("rule_bit"), F.lit(mask(policy)).cast("bigint").alias("policy_mask")) for r in POLICIES[policy]])))
    each = each.select("failure_bits", "n", "rule_row.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(relevant == F.col("rule_bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(relevant.bitwiseAND(F.bitwise_not(F.col("rule_bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_and(F.when(failed, F.col("failure_bits"))).alias("all_fail_bits"),
        F.bit_or(F.when(failed, F.col("failure_bits"))).alias("any_fail_bits"),
    )


def with_ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with what a policy does to each row and what its ablations would: kept; only_rule, the rule that alone removes the
    row (null where none or several do); n_only, how many rows that rule alone removes; n_kept_without, how many rows would be kept
    without it (both null where only_rule is).

    The counts are those of ablations(), a row for each rule of the policy, which are broadcast. Every row of the ledger stays, also
    repeated ones and those without a doc_id; an empty ledger gives none.
    """
    alone = F.col("failure_bits").bitwiseAND(F.lit(mask(policy)))
    only = F.coalesce(*[F.when(alone == bit(r), F.lit(r)) for r in POLICIES[policy]])
    counts = ablations(ledger, policy).select(F.col("rule").alias("only_rule"), "n_only", "n_kept_without")
    return apply_policy(ledger, policy).withColumn("only_rule", only).join(F.broadcast(counts), "only_rule", "left")
