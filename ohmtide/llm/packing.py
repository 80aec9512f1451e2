"""Best-fit packing of documents into sequences of fixed length, by exact complements.

What matters for packing is only how many pieces of each length there are, at most as many numbers as the sequence length; the
driver plans on these. It takes the longest length left and looks up what fills the gap exactly: one length, a sum of two, a
sum of three, from an index of such sums that holds what is still available. If nothing does, the best fit (the longest length
that goes into the gap) is added, and the rest of the gap is looked up again. Each plan is used as often as the counts allow, so
each leaves fewer pieces of one of its lengths than it takes; there are about as many plans as lengths, however many pieces. The pieces then find their places by their
rank among those of their length, which is counted by partition and summed, so no task or driver ever sees all pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmtide.llm.common import drop_written, written
from ohmtide.llm.encoding import encoder, texts_of

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


class SumIndex:
    """Single, pair and triple sums of the lengths that are available."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.size = len(counts) - 1
        have = self.left > 0
        self.pairs = np.zeros(self.size + 1, np.int64)  # unordered pairs a <= b of available lengths, by their sum
        for a in np.flatnonzero(have):
            b = np.flatnonzero(have[a : self.size + 1 - a]) + a
            self.pairs[a + b] += 1
        self._triples: np.ndarray | None = None

    @property
    def triples(self) -> np.ndarray:
        """In how many ways a length and a pair make each sum; built anew after a length has run out."""
        if self._triples is None:
            self._triples = np.convolve((self.left > 0).astype(np.int64), (self.pairs > 0).astype(np.int64))[: self.size + 1]
        return self._triples

    def take(self, lengths: list[int], times: int) -> None:
        for length, n in Counter(lengths).items():
            self.left[length] -= n * times
            if self.left[length] == 0:
                self._triples = None
                b = np.flatnonzero(self.left[: self.size + 1 - length] > 0)
                self.pairs[length + b] -= 1
                if 2 * length <= self.size:
                    self.pairs[2 * length] -= 1

    def _allowed(self, used: Counter, more: tuple[int, ...]) -> bool:
        want = used + Counter(more)
        return all(self.left[x] >= want[x] for x in more)

    def fill(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to the gap, besides those used."""
        if self._allowed(used, (gap,)) and self.left[gap] > 0:
            return (gap,)
        pair = self._pair(gap, used)
        if pair:
            return pair
        if not self.triples[gap]:
            return None
        # The largest first: short lengths fill more gaps later.
        for a in np.flatnonzero((self.left[1:gap] > 0) & (self.pairs[gap - 1 : 0 : -1] > 0))[::-1] + 1:
            if self._allowed(used, (int(a),)) and (pair := self._pair(gap - int(a), used + Counter((int(a),)))):
                return (int(a), *pair)
        return None

    def _pair(self, gap: int, used: Counter) -> tuple[int, int] | None:
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        low = np.arange(1, gap // 2 + 1)
        for a in low[(self.left[low] > 0) & (self.left[gap - low] > 0)]:
            if self._allowed(used, (int(gap - a), int(a))):
                return int(gap - a), int(a)
        return None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths that share a sequence, number of such sequences), for counts[length] pieces of each length up to the sequence's."""
    index, size, plans = SumIndex(counts), len(counts) - 1, []
    longest = size
    while longest:
        if index.left[longest] == 0:
            longest -= 1
            continue
        lengths, used, gap = [longest], Counter((longest,)), size - longest
        while gap:
            if more := index.fill(gap, used):
                lengths += more
                break
            free = index.left[1 : gap + 1].copy()
            for x, n in used.items():
                if x <= gap:
                    free[x - 1] -= n
            fits = np.flatnonzero(free > 0)
            if not len(fits):
                break
            lengths.append(int(fits[-1]) + 1)
            used[lengths[-1]] += 1
            gap -= lengths[-1]
        used = Counter(lengths)
        times = int(min(index.left[x] // n for x, n in used.items()))
        index.take(lengths, times)
        plans.append((sorted(lengths, reverse=True), times))
    return plans


def places(plans: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, times, first sequence, offset) for each length of each plan."""
    out, taken, sequence = [], Counter(), 0
    for lengths, times in plans:
        at = 0
        for x, n in sorted(Counter(lengths).items(), reverse=True):
            out.append((x, taken[x], taken[x] + n * times, times, sequence, at))
            taken[x] += n * times
            at += n * x
        sequence += times
    return out


def pieces(documents: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """Each document's ids and the end id, cut only where longer than `size`: the first piece takes what is over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for at, lot in texts_of(batch.column(1)):
                rows = []
                for i, ids in enumerate(own.encode(lot)):
                    ids = np.array([*ids, end_id], "<u4")
                    n, start, k = len(ids), 0, 0
                    while start < n:
                        length = min((n - start - 1) % size + 1 if not start else size, n - start)
                        rows.append((at + i, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]))
                        seen[length] += 1
                        start, k = start + length, k + 1
                row, k, start, length, crc, nth = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of `documents`.

    Only doc_id and text are read; a null text counts as empty and has the end id alone; a null doc_id is kept; each repeated row
    is packed for itself; an empty table gives no rows; any number of pieces may have the same length. Long texts are encoded
    whole and cut into pieces of `size`, of which the first may be shorter.
    """
    spark = documents.sparkSession
    cut = written(pieces(documents, tokenizer, size, end_id), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    # At most a row for each length of each plan: bounded by the number of lengths, not of pieces.
    names = ["p_length", "low", "high", "times", "first", "at"]
    # Through Arrow: rows of Python would start a second pool of workers in each executor, which stays.
    found = np.array(places(plan(counts)), np.int64).reshape(-1, len(names))
    table = spark.createDataFrame(pa.table(list(found.T), names))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(table), F.expr("length = p_length AND rank >= low AND rank < high"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first + (rank - low) % times").alias("sequence_id"),
        F.expr("at + (rank - low) DIV times * length").alias("offset"),
    )


__all__ = ["SumIndex", "drop_written", "pack", "pieces", "places", "plan"]
