"""Line dedup by content-defined chunks.

A text is cut into chunks of lines. A line of STEADY or more words is a chunk of its own; among shorter ones, a rolling hash over the
hashes of two lines in a row chooses where a chunk ends. So a boundary depends on what stands there alone, moves with it, and settles
at the first line of a passage or the one after. Chunks are compared two neighbours at a time (several lines always), and alone where
they have LONG or more words. What occurs more than once in all documents is found by digest and then compared byte by byte; every
occurrence but the first (by doc_id, then place) marks its chunks, and runs of marked chunks with LONG or more words are removed. The
first occurrence of a chunk is never marked, so no line is lost from the corpus.

Lines are cut and hashed in Arrow batches; what is shuffled are digests, and the bytes of repeated chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.common import drop_written, join_dealt, join_small, quoted, written

#: Words from which a line is a chunk of its own, and words from which what repeats is removed.
STEADY, LONG = 8, 40
#: A boundary follows one in so many pairs of shorter lines.
DIVISOR = 2

Chunk = tuple[int, bytes, int, int]


def line_hash(line: bytes) -> int:
    """The first 32 bits of a line's MD5."""
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def digest(unit: bytes) -> bytes:
    return hashlib.md5(unit).digest()


def chunks_of(raw: bytes) -> list[Chunk]:
    """(index of the first line, bytes, words, lines with words) of each chunk of a text in UTF-8, in order; they join to the text
    by line breaks."""
    lines = raw.split(b"\n")
    n_words = [len(line.split()) for line in lines]
    out, start, before = [], 0, 0
    for i, n in enumerate(n_words):
        ends = n >= STEADY or i == len(lines) - 1 or n_words[i + 1] >= STEADY
        if not ends:
            own = line_hash(lines[i])
            ends, before = ((31 * before + 17 * own) % (1 << 32) >> 7) % DIVISOR == 0, own
        else:
            before = 0
        if ends:
            part = n_words[start : i + 1]
            out.append((start, b"\n".join(lines[start : i + 1]), sum(part), sum(x > 0 for x in part)))
            start = i + 1
    return out


def units_of(chunks: list[Chunk]) -> Iterator[tuple[int, int, bytes]]:
    """(first chunk, number of chunks, bytes) of what is compared; the bytes begin with the number."""
    for k, (_, own, n_words, _) in enumerate(chunks):
        if k + 1 < len(chunks):
            yield k, 2, b"2" + own + b"\n" + chunks[k + 1][1]
        if n_words >= LONG:
            yield k, 1, b"1" + own


def without(raw: bytes, marks: set[tuple[int, bytes]], key: Callable[[bytes], bytes]) -> tuple[bytes, int, int]:
    """A text without the runs of chunks that units (first line, digest) mark, and how many chunks and lines with words these had."""
    chunks = chunks_of(raw)
    marked = [False] * len(chunks)
    for k, n, unit in units_of(chunks):
        if (chunks[k][0], key(unit)) in marks:
            marked[k : k + n] = [True] * n
    kept, gone, k = [], [], 0
    while k < len(chunks):
        end = k + 1
        while marked[k] and end < len(chunks) and marked[end]:
            end += 1
        away = marked[k] and sum(c[2] for c in chunks[k:end]) >= LONG
        (gone if away else kept).extend(chunks[k:end])
        k = end
    return b"\n".join(c[1] for c in kept), len(gone), sum(c[3] for c in gone)


def repeated(documents: DataFrame, key: Callable[[bytes], bytes] = digest) -> DataFrame:
    """A table of doc_id, th (the text's xxhash64), at and digest of every occurrence, after the first, of a unit that occurs more than
    once; `at` is the unit's first line."""
    spark, kind = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()

    def cut(of: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, size = [], 0
                for i in range(batch.num_rows):
                    for row in of(batch, i):
                        found.append((i, *row))
                        size += 40 if len(row) == 2 else len(row[2])
                    if size > 1 << 22 or (found and i == batch.num_rows - 1):
                        at, *rest = zip(*found)
                        kinds = [pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (0, 1)), *(pa.array(v, t) for v, t in zip(rest, kinds))], ["doc_id", "th", "at", "digest", "unit"][: 2 + len(rest)])
                        found, size = [], 0

        return run

    def every(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
        chunks = chunks_of((batch.column(2)[i].as_py() or "").encode())
        for k, _, unit in units_of(chunks):
            yield chunks[k][0], key(unit)

    def listed(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
        chunks, wanted = chunks_of((batch.column(2)[i].as_py() or "").encode()), set(batch.column(3)[i].as_py())
        for k, _, unit in units_of(chunks):
            d = key(unit)
            if d in wanted:
                yield chunks[k][0], d, unit

    texts = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = written(texts.mapInArrow(cut(every), f"doc_id {kind}, th bigint, at int, digest binary"), "units")
    # A null doc_id comes last, so that its row is never the first of others.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("at"))
    found = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "unit-digests")
    again = written(join_dealt(rows, found.select("digest", "first"), found.select("digest", F.col("n").alias("ohmtide_n")), ["digest"]), "units-again")
    # Byte comparison: of documents with repeated digests, the units that have them. Copies meet in partial sums before the shuffle.
    lists = written(again.select("doc_id", "th", "digest").distinct().groupBy("doc_id", "th").agg(F.collect_list("digest").alias("wanted")).withColumnsRenamed({"doc_id": "w_id", "th": "w_th"}), "unit-lists")
    mine = join_small(texts, lists, lists.count(), F.expr("doc_id <=> w_id AND th = w_th"), "inner").select("doc_id", "th", "text", "wanted")
    units = mine.mapInArrow(cut(listed), f"doc_id {kind}, th bigint, at int, digest binary, unit binary")
    seen = written(units.groupBy("digest", "unit").agg(F.min(place).alias("first")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "unit-clashes")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    n_mixed = seen.count()
    if n_mixed:
        # Different bytes with one digest are told apart: each has its own first place.
        same = join_small(again, seen, n_mixed, ["digest"], "left_anti").where(later).select("doc_id", "th", "at", "digest")
        mixed = written(join_small(units, seen, n_mixed, ["digest"], "left_semi"), "units-mixed")
        firsts = mixed.groupBy("digest", "unit").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        told = join_dealt(mixed, firsts.drop("n"), firsts.select("digest", "unit", F.col("n").alias("ohmtide_n")), ["digest", "unit"]).where(later)
        gone = same.unionByName(told.select("doc_id", "th", "at", "digest"))
    else:
        gone = again.where(later).select("doc_id", "th", "at", "digest")
    gone = written(gone.distinct(), "units-gone")
    for old in (rows, found, again, lists, seen):
        drop_written(spark, old)
    return gone


def dedup_lines(documents: DataFrame, key: Callable[[bytes], bytes] = digest, names: tuple[str, str] = ("removed_chunks", "removed_lines")) -> DataFrame:
    """All columns of `documents` with repeated runs of chunks taken out of `text`, and how many chunks and lines with words these had,
    under the two `names` (long); columns of these names in the input give way to them.

    Nulls stay null, and lose nothing; rows without repeated chunks are unchanged to the byte. Rows that share a doc_id are one
    document: what occurs at the same line of both counts once, so repeated rows stay or go alike; rows without a doc_id are one such
    document, the last. A text whose chunks all go is left empty. An empty table gives no rows. A text of any length is cut as a
    whole in one task, in a few times its bytes. Other columns may have any names: they are not looked at.
    """
    gone = repeated(documents, key)
    lists = written(gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "digest")).alias("ohmtide_gone")).withColumnsRenamed({"doc_id": "ohmtide_id", "th": "ohmtide_th"}), "unit-marks")
    joined = join_small(documents, lists, lists.count(), (quoted("doc_id").eqNullSafe(F.col("ohmtide_id"))) & (F.xxhash64("text") == F.col("ohmtide_th")), "left")

    def kept(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if t is None or m is None else without(t.encode(), {(x["at"], bytes(x["digest"])) for x in m}, key) for t, m in zip(texts, marks)]
        return pd.DataFrame([(None if t is None else t.decode(), c, n) for t, c, n in rows], columns=["text", "chunks", "lines"])

    # As a function that may not be run twice: else a filter on its counts is moved below it, runs it again, and holds a second worker.
    own = F.pandas_udf(kept, "text string, chunks bigint, lines bigint").asNondeterministic()
    result = joined.withColumn("ohmtide_kept", own(F.when(F.col("ohmtide_gone").isNotNull(), F.col("text")), F.col("ohmtide_gone")))
    columns = [F.coalesce("ohmtide_kept.text", "text").alias("text") if c == "text" else quoted(c) for c in documents.columns if c not in names]
    return result.select(*columns, F.col("ohmtide_kept.chunks").alias(names[0]), F.col("ohmtide_kept.lines").alias(names[1]))
