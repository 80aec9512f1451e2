"""Queries of the readers: files are made from table rows in the shared scratch folder, parsed, and compared with what was written."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.functions.scalars import source_uid
from ohmtide.operators.scratch import scratch
from ohmtide.operators.sequence import time_summary
from ohmtide.plans import bridge as B
from ohmtide.sources import files as S
from ohmtide.sources import irf, text

QUERIES, SQL = {}, {}
#: Points of a file. Of each seven lines of data the fourth is blank and the sixth has no number.
LINES = 21


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _files(spark: SparkSession, contents: DataFrame) -> DataFrame:
    """Discovered files with column k, for rows (k, value) of whole texts: one file each, in a folder named after its key."""
    folder = scratch(spark)
    contents.write.partitionBy("k").text(folder)
    found = S.discover(spark, [folder])
    return found.withColumn("k", F.regexp_extract("path", "/k=([^/]+)/", 1).cast("bigint"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in three layouts: comma with kHz and mohm, semicolon with the sign the other way round, tab with a preamble."""
    k, i = F.col("k"), F.col("i")
    keys = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    each = keys.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LINES - 1))))
    mark = F.when(k % 3 == 0, ",").when(k % 3 == 1, ";").otherwise("\t")
    f, re, im = F.lit(1000) - 10 * i, k + i, 2 * i + 1
    row = F.when(k % 3 == 0, F.concat_ws(",", f / 1000, re * 1000, im * 1000)).when(k % 3 == 1, F.concat_ws(";", f, re, -im)).otherwise(F.concat_ws("\t", f, re, im))
    row = F.when(i % 7 == 3, "").when(i % 7 == 5, F.concat(F.lit("none"), mark, F.lit("1"), mark, F.lit("2"))).otherwise(row)
    head = F.when(k % 3 == 0, "Frequency (kHz),Z' (mohm),-Z'' (mohm)").when(k % 3 == 1, "freq/Hz;Zreal (ohm);Zimag (ohm)").otherwise("Run 7, by hand\n\nFrequency (Hz)\tReal (Ohm)\tneg_Zimag (Ohm)")
    body = each.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"))
    return body.select("k", F.concat(head, F.lit("\n"), "body").alias("value"))


_LINES = f"l AS (SELECT s_suppkey AS k, unnest(range({LINES}))::INT AS i FROM supplier)"


@query(f"""WITH {_LINES} SELECT k, (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::INT AS i, round(1000e0 - 10 * i, 6) AS frequency_hz, (k + i)::DOUBLE AS zreal, (2 * i + 1)::DOUBLE AS neg_zimag, 'ohm' AS basis
FROM l WHERE i % 7 NOT IN (3, 5)""")
def read_text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, _texts(spark, sf_dir))
    points = text.parse(files)[2].join(files.select("source_uid", "k"), "source_uid")
    r6 = lambda c: F.round(c, 6).alias(c)
    return points.select("k", F.col("i").cast("int").alias("i"), r6("frequency_hz"), r6("zreal"), r6("neg_zimag"), "basis")


@query(f"""WITH {_LINES}, h AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 2 THEN 3 ELSE 1 END AS head FROM supplier)
SELECT k, (head + 1 + i)::INT AS source_line, CASE WHEN i % 7 IN (3, 5) THEN 'excluded' ELSE 'included' END AS status, CASE i % 7 WHEN 3 THEN 'blank_row' WHEN 5 THEN 'nonnumeric_or_nonfinite' ELSE 'valid-eis-row' END AS reason FROM l JOIN h USING (k)
UNION ALL SELECT k, n::INT, CASE WHEN n = head THEN 'header' ELSE 'preamble' END, CASE WHEN n = head THEN 'header' ELSE 'preamble' END FROM (SELECT k, head, unnest(range(1, head + 1)) AS n FROM h)""")
def read_text_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every file, with what became of it."""
    files = _files(spark, _texts(spark, sf_dir))
    return text.parse(files)[1].join(files.select("source_uid", "k"), "source_uid").select("k", F.col("source_line").cast("int").alias("source_line"), "status", "reason")


_TIMES = """t AS (SELECT s_suppkey AS k, i, 0.5e0 * CASE WHEN s_suppkey % 3 = 0 AND i = 10 THEN 9 ELSE i END + CASE WHEN s_suppkey % 2 = 0 AND i >= 6 THEN 10 ELSE 0 END AS minutes
FROM supplier, (SELECT unnest(range(16)) AS i)), s AS (SELECT k, i, minutes * 60 AS t, minutes * 60 - lag(minutes * 60) OVER (PARTITION BY k ORDER BY i) AS step FROM t)"""


@query(f"""WITH {_TIMES} SELECT k, round(min_by(t, i), 6) AS start_s, round(max_by(t, i), 6) AS end_s, round(max(t) - min(t), 6) AS duration_s, round(median(step) FILTER (WHERE step > 0), 6) AS median_step, round(min(step), 6) AS least_step,
  round(max(step), 6) AS largest_step, bool_and(step > 0) AS increasing, (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS anomalies,
  CASE WHEN k % 2 = 0 THEN 6 WHEN k % 3 = 0 THEN 10 END::BIGINT AS first_anomaly FROM s GROUP BY k""")
def read_text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of acquisition in minutes, read to seconds: every half minute, with a pause before the seventh line of even files, and the
    eleventh line of every third file at the time of the tenth."""
    k, i = F.col("k"), F.col("i")
    each = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))
    minutes = 0.5 * F.when((k % 3 == 0) & (i == 10), 9).otherwise(i) + F.when((k % 2 == 0) & (i >= 6), 10).otherwise(0)
    row = F.concat_ws(",", 1000 - 10 * i, F.lit(1), F.lit(2), minutes)
    body = each.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"))
    files = _files(spark, body.select("k", F.concat(F.lit("Frequency (Hz),Z' (ohm),-Z'' (ohm),Time (min)\n"), "body").alias("value")))
    # A header of times alone or in seconds is known; one in minutes is declared.
    layout = text.Layout(delimiter="comma", columns={"frequency": 0, "zreal": 1, "zimag": 2, "time": 3})
    points = text.parse(files, layout)[2].where("time_unit = 's'").join(files.select("source_uid", "k"), "source_uid")
    found = time_summary(points, "k", "i", "acquisition_time")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return found.select("k", r6("start", "start_s"), r6("end", "end_s"), r6("duration", "duration_s"), r6("median_step", "median_step"), r6("least_step", "least_step"), r6("largest_step", "largest_step"), "increasing", "anomalies", F.get("first_anomalies", F.lit(0))["order"].cast("bigint").alias("first_anomaly"))


#: A header, and why its file is refused; the last is taken.
REFUSED = (
    ("Frequency,Z' (ohm),-Z'' (ohm)", "ambiguous-frequency-unit"), ("Frequency (Hz),Z',-Z''", "ambiguous-impedance-unit"), ("Frequency (Hz),Z' (ohm),-Z'' (ohm cm2)", "incompatible-units"),
    ("Frequency (Hz),freq (Hz),Z' (ohm),-Z'' (ohm)", "ambiguous-columns"), ("a,b,c", "no-impedance-header"), ("Frequency (Hz),Z' (ohm),-Z'' (ohm)", None),
)
_REFUSED = ", ".join(f"({i}, {'NULL' if e is None else repr(e)})" for i, (_, e) in enumerate(REFUSED))


@query(f"""SELECT n_nationkey AS k, CASE WHEN e IS NULL THEN 'parsed' ELSE 'failed' END AS status, e AS error FROM nation JOIN (VALUES {_REFUSED}) v(i, e) ON n_nationkey % {len(REFUSED)} = i""")
def read_text_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be read without a guess are rows with the reason."""
    k = F.col("k")
    head = F.element_at(F.array(*[F.lit(h) for h, _ in REFUSED]), (k % len(REFUSED) + 1).cast("int"))
    texts = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k")).select("k", F.concat(head, F.lit("\n100,1,2,3\n10,2,3,4")).alias("value"))
    files = _files(spark, texts)
    return text.parse(files)[0].join(files.select("source_uid", "k"), "source_uid").select("k", "status", "error")


@query("""SELECT s_suppkey AS k, '.txt' AS suffix, sha256(s_name || chr(10) || 'second line' || chr(10)) AS source_sha256, length(s_name || chr(10) || 'second line' || chr(10))::BIGINT AS n_bytes, 24::INT AS uid_length FROM supplier""")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sizes, digests and identities of files."""
    texts = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat("s_name", F.lit("\nsecond line")).alias("value"))
    return _files(spark, texts).select("k", "suffix", "source_sha256", F.octet_length("content").cast("bigint").alias("n_bytes"), F.length("source_uid").alias("uid_length"))


def _containers(keys: DataFrame) -> DataFrame:
    """(path, source_uid, content) of ZIP files with one database each, for rows (k): eleven rows stored from low frequency on, of
    which one is not valid and one has no frequency, and k % 3 safety events. A second database has two sweeps, and documents program it:
    as measured, 5 % off at one point, or one point short, by k % 3; the first document is no JSON."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["k"]:
                con = sqlite3.connect(":memory:")
                con.execute('CREATE TABLE "Sweep" ("Index" REAL, VerifiedAppliedFrequency REAL, ImpedanceReal REAL, ImpedanceImaginary REAL, Valid INTEGER)')
                con.executemany('INSERT INTO "Sweep" VALUES (?, ?, ?, ?, ?)', [(10 - i, -1.0 if i == 8 else 2.0**i, k + i, -i, 0 if i == 4 else 1) for i in range(11)])
                con.execute('CREATE TABLE "SafetyStateEntries" (State TEXT)')
                con.executemany('INSERT INTO "SafetyStateEntries" VALUES (?)', [("limit",)] * (k % 3))
                con.commit()
                two = sqlite3.connect(":memory:")
                two.execute('CREATE TABLE "Twice" (VerifiedAppliedFrequency REAL, ImpedanceReal REAL, ImpedanceImaginary REAL)')
                two.executemany('INSERT INTO "Twice" VALUES (?, ?, ?)', [(2.0 ** (6 - i % 6), k, -1) for i in range(12)])
                two.commit()
                program = [[2.0 ** (6 - i % 6) * (1.05 if k % 3 == 1 and i == 4 else 1.0), "x"] for i in range(12 - (k % 3 == 2))]
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as archive:
                    archive.writestr("run.db", con.serialize())
                    archive.writestr("two.db", two.serialize())
                    archive.writestr("a.json", "{")
                    archive.writestr("b.json", json.dumps({"Steps": [{"State": f"s{k}", "HeaderParameters": [{"Label": "Amplitude", "Value": k}]}, {"FrequencyDistribution": program}]}))
                con.close()
                two.close()
                out.append((f"/made/{k}.irf", raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    made = keys.select("k").mapInPandas(build, "path string, content binary")
    return made.select("path", source_uid(F.col("path")).alias("source_uid"), "content")


@query("""SELECT k, (10 - i)::INT AS i, CASE WHEN i = 8 THEN -1e0 ELSE pow(2e0, i) END AS frequency_hz, (k + i)::DOUBLE AS zreal, i::DOUBLE AS neg_zimag, CASE i WHEN 4 THEN 'Valid=0' WHEN 8 THEN 'nonpositive_frequency' END AS reason, (k % 3)::INT AS events
FROM (SELECT s_suppkey AS k, unnest(range(11)) AS i FROM supplier)""")
def read_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of instrument containers in the order of their index, kept or with the reason why not."""
    keys = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    found = irf.read(_containers(keys)).where("spectrum_id = 'run.db:Sweep'")
    return found.select(F.regexp_extract("path", r"(\d+)\.irf$", 1).cast("bigint").alias("k"), "i", "frequency_hz", "zreal", (F.col("neg_zimag") + 0.0).alias("neg_zimag"), "reason", "events")


def _key() -> Column:
    return F.regexp_extract("path", r"(\d+)\.irf$", 1).cast("bigint").alias("k")


@query("""SELECT k, 'run.db:Sweep:run1' AS spectrum_id, (row_number() OVER (PARTITION BY k ORDER BY i DESC) - 1)::INT AS point, pow(2e0, i) AS frequency_hz FROM (SELECT s_suppkey AS k, unnest(range(11)) AS i FROM supplier) WHERE i NOT IN (4, 8)
UNION ALL SELECT k, 'two.db:Twice:run' || (1 + i // 6), (i % 6)::INT, pow(2e0, 6 - i % 6) FROM (SELECT s_suppkey AS k, unnest(range(12)) AS i FROM supplier)""")
def container_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of containers, cut into sweeps."""
    found = irf.spectra(irf.read(_containers(B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))))
    return found.select(_key(), "spectrum_id", F.col("point").cast("int").alias("point"), "frequency_hz")


@query("""SELECT s_suppkey AS k, 'run.db' AS member, unnest(range(s_suppkey % 3))::INT AS i, 'limit' AS state FROM supplier""")
def container_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety events of containers, a row each."""
    found = irf.events(_containers(B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))))
    return found.select(_key(), "member", "i", F.get_json_object("event", "$.State").alias("state"))


@query("""SELECT s_suppkey AS k, 'a.json' AS member, NULL AS state, NULL AS label, NULL::INT AS n_programmed, 'no-json' AS error FROM supplier
UNION ALL SELECT s_suppkey, 'b.json', 's' || s_suppkey, 'Amplitude', 12 - CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 0 END, NULL FROM supplier""")
def container_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents of containers say of the procedure."""
    found = irf.procedures(_containers(B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))))
    return found.select(_key(), "member", "state", F.get_json_object("header_parameters", "$[0].Label").alias("label"), F.size("programmed").alias("n_programmed"), "error")


@query("""SELECT k, spectrum_id, programmed_points::INT AS programmed_points, measured_points::INT AS measured_points, CASE WHEN programmed_points = measured_points THEN CASE k % 3 WHEN 1 THEN round(0.05 / 1.05, 6) ELSE 0e0 END END AS off, programmed_points = measured_points AND k % 3 = 0 AS kept_to
FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 2 THEN 11 ELSE 12 END AS programmed_points FROM supplier), (VALUES ('run.db:Sweep', 9), ('two.db:Twice', 12)) v(spectrum_id, measured_points)""")
def container_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmed frequencies of containers against the measured ones."""
    files = _containers(B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))
    found = irf.schedules(irf.read(files), irf.procedures(files))
    return found.select(_key(), "spectrum_id", "programmed_points", "measured_points", F.round("max_relative_difference", 6).alias("off"), "kept_to")
