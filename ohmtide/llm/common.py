"""What the training-data operators share: scratch tables in the cluster's shared folder, and vectorised text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows up to which the side of a join is sent to all executors; a row of these joins has at most 40 bytes.
BROADCAST_ROWS = 200_000
#: Text is worked on in pieces of about so many bytes, so that a kernel's arrays stay small.
PIECE_BYTES = 1 << 19

ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; only where that is unset (tests on one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ohmtide-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ohmtide-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ohmtide-" in folder:
            path = hadoop(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(left: DataFrame, right: DataFrame, rows: int, on: list[str], how: str) -> DataFrame:
    """left joined with right, of which `rows` were counted: sent to all executors where few, shuffled where many."""
    from pyspark.sql import functions as F

    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def join_dealt(left: DataFrame, right: DataFrame, counts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined ("inner" or "left") with right, which has at most one row a key, where `counts` (on, ohmtide_n) says how many rows
    of left a key has.

    Keys with more rows than a quarter of a task's fair share are at most four times as many as tasks; their rows stay where they
    are and meet a broadcast of just these keys. All others are shuffled, and no task gets many rows of one key.
    """
    from pyspark.sql import functions as F

    parts = shuffle_parts(left.sparkSession)
    total = counts.agg(F.sum("ohmtide_n")).first()[0] or 0
    hot = written(counts.where(F.col("ohmtide_n") * 4 * parts > total).select(*on), "hot-keys")
    if not hot.count():
        return left.join(right.hint("merge"), on, how)
    met = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    return met.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right.hint("merge"), on, how))


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of a table with the highest counts, at most `most`: all over a threshold that a histogram gives (eight steps an octave,
    so that what comes to the driver has a few hundred rows). Rows of equal counts stay together; none may be left."""
    from pyspark.sql import functions as F

    step = F.floor(F.log2(F.col(count)) * 8)
    taken, least = 0, None
    for s, n in counted.where(F.col(count) > 0).groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        if taken + n > most:
            break
        taken, least = taken + n, s
    return counted.where(F.lit(False)) if least is None else counted.where((F.col(count) > 0) & (step >= least))


def quoted(name: str):
    """A column by its whole name, which may have dots and back-quotes."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: A 64-bit value for each byte, capitals as small letters.
_BYTE = _table(7, 256)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * PIECE_BYTES:
            _powers[str(base)] = have
    return have


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all rows begin and end, and the index of each row's first word (one more than rows)."""
    w = is_word[data]
    before = np.empty_like(w)
    before[:1] = False
    before[1:] = w[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(w)]
    before[inner] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1:] = False
    after[:-1] = w[1:]
    inner = inner[inner > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


NON_SPACE = np.ones(256, bool)
NON_SPACE[list(ASCII_SPACE)] = False


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lowered: a polynomial over byte values, from prefix sums, then mixed with the length."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], out=total[1:])
        h = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEP = [np.uint64(x) for x in _table(11, 64) | np.uint64(1)]


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(k):
            h += words[j : j + n] * _STEP[j]
        return mix(h)
