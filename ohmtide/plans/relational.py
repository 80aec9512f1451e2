"""Queries of the relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.functions import metadata as M
from ohmtide.functions import scalars as S
from ohmtide.operators import controls as C
from ohmtide.operators import screens as R
from ohmtide.operators import sequence as Q
from ohmtide.operators import tables as T
from ohmtide.plans import bridge as B
from ohmtide.sources.ledger import exclusion_reason

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str, d: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, d) + F.lit(0.0)


@query(f"""WITH {B.SQL} SELECT uid, i, round(sqrt(zreal * zreal + neg_zimag * neg_zimag), 6) + 0e0 AS modulus, round(degrees(atan2(-neg_zimag, zreal)), 6) + 0e0 AS phase_degrees FROM p""")
def modulus_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir)
    return p.select("uid", "i", r6(S.modulus(F.col("zreal"), F.col("neg_zimag"))).alias("modulus"), r6(S.phase_degrees(F.col("zreal"), F.col("neg_zimag"))).alias("phase_degrees"))


@query(f"""WITH {B.SQL} SELECT uid, i, round(log10(2 * pi() * frequency_hz), 8) + 0e0 AS log_omega, round(log10(1 / (2 * pi() * frequency_hz)), 8) + 0e0 AS log_tau,
  round(CASE WHEN uid % 3 = 0 THEN zreal WHEN uid % 3 = 1 THEN zreal * 2.5e0 END, 6) + 0e0 AS zreal_cm2 FROM p""")
def omega_tau_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, area = F.when(F.col("uid") % 3 == 0, "ohm_cm2").otherwise("ohm"), F.when(F.col("uid") % 3 == 1, 2.5)
    f = F.col("frequency_hz")
    return B.points(spark, sf_dir).select("uid", "i", r6(F.log10(S.omega(f)), 8).alias("log_omega"), r6(F.log10(S.tau(f)), 8).alias("log_tau"), r6(S.area_normalized(F.col("zreal"), basis, area)).alias("zreal_cm2"))


@query("""SELECT doc_id, substr(sha256('source' || chr(31) || source), 1, 24) AS source_uid,
  substr(sha256('spectrum' || chr(31) || substr(sha256('source' || chr(31) || source), 1, 24) || chr(31) || sha256(coalesce(text, '')) || chr(31) || doc_id), 1, 24) AS spectrum_uid FROM documents""")
def spectrum_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").withColumn("s", S.source_uid(F.col("source")))
    content = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return d.select("doc_id", F.col("s").alias("source_uid"), S.spectrum_uid(F.col("s"), content, F.col("doc_id")).alias("spectrum_uid"))


HEADERS = [
    ("Frequency (Hz)", 1.0, None, None, "frequency", None), ("Frequency (kHz)", 1e3, None, None, "frequency", None), ("freq/mHz", 1e-3, None, None, "frequency", None), ("f (MHz)", 1e6, None, None, None, None),
    ("频率(Hz)", 1.0, None, None, "frequency", None), ("Freq", None, None, None, "frequency", None), ("Hz kHz", None, None, None, None, None),
    ("Z' (ohm)", None, 1.0, "ohm", "zreal", None), ("-Z'' (ohm)", None, 1.0, "ohm", "zimag", 1), ("Zreal (mohm)", None, 1e-3, "ohm", "zreal", None), ("Zimag (mohm)", None, 1e-3, "ohm", "zimag", -1),
    ("Z_double_prime/kOhm", None, 1e3, "ohm", "zimag", -1), ("Imag (MOhm cm^2)", None, 1e6, "ohm_cm2", "zimag", -1), ("Real (ohm)", None, 1.0, "ohm", "zreal", None), ("neg_Zimag (Ohm)", None, 1.0, "ohm", "zimag", 1), ("Z' (ohm/cm2)", None, None, None, "zreal", None),
    ("Z' (ohm m^2)", None, None, None, "zreal", None), ("|Z| (ohm)", None, 1.0, "ohm", "modulus", None), ("Phase (deg)", None, None, None, "phase", None), ("Valid", None, None, None, "valid", None), ("Index", None, None, None, "index", None), ("elapsed time", None, None, None, "time", None),
    ("有效", None, None, None, "valid", None), ("Comment", None, None, None, None, None),
]
_H = ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) for x in h) + ")" for h in HEADERS)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(h[0],) for h in HEADERS], "header string")
    return B.read(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(names))


@query(f"""SELECT n_nationkey, header, f::DOUBLE AS frequency_factor, z::DOUBLE AS impedance_factor, basis FROM nation, (VALUES {_H}) h(header, f, z, basis, role, sign)""")
def unit_scale_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = S.impedance_scale(F.col("header"))
    return _headers(spark, sf_dir).select("n_nationkey", "header", S.frequency_scale(F.col("header")).alias("frequency_factor"), z["factor"].alias("impedance_factor"), z["basis"].alias("basis"))


@query(f"""SELECT n_nationkey, header, role, sign::INT AS sign FROM nation, (VALUES {_H}) h(header, f, z, basis, role, sign)""")
def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("header")
    return _headers(spark, sf_dir).select("n_nationkey", "header", S.header_role(h).alias("role"), S.imaginary_sign(h).cast("int").alias("sign"))


@query("""SELECT doc_id, i::INT AS source_line, length(l[i])::BIGINT AS n_chars, CASE WHEN trim(l[i], ' ' || chr(9)) = '' THEN 'blank' ELSE 'text' END AS status
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def line_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("source_line"), F.length("line").cast("bigint").alias("n_chars"), F.when(F.trim(F.col("line"), F.lit(" \t")) == "", "blank").otherwise("text").alias("status"))


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    valid = F.when(e % 13 == 0, "x").when(e % 13 == 1, "0").otherwise("1")
    f = F.when(e % 17 == 0, "nan").when(e % 19 == 0, "-5").otherwise(F.concat((1 + e % 1000).cast("string"), F.lit("e2")))
    zr = F.when(e % 23 == 0, "1e308").otherwise((e % 50).cast("string"))
    fields = F.when(e % 29 == 0, F.array(F.lit(" "))).when(e % 31 == 0, F.array(f)).otherwise(F.array(f, zr, (e % 7).cast("string"), valid))
    return B.read(spark, sf_dir, "events").select("event_id", "user_id", fields.alias("raw_fields"))


_REASON = """SELECT event_id, user_id, CASE WHEN event_id % 29 = 0 THEN 'blank_row' WHEN event_id % 31 = 0 THEN 'short_row' WHEN event_id % 13 = 0 THEN 'invalid_valid_flag' WHEN event_id % 13 = 1 THEN 'Valid=0'
  WHEN event_id % 17 = 0 THEN 'nonnumeric_or_nonfinite' WHEN event_id % 23 = 0 THEN 'nonfinite_after_unit_conversion' WHEN event_id % 19 = 0 THEN 'nonpositive_frequency' END AS reason FROM events"""


@query(_REASON.replace("event_id, user_id,", "event_id,", 1))
def row_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"frequency": 0, "zreal": 1, "zimag": 2, "valid": 3}
    return _raw_rows(spark, sf_dir).select("event_id", exclusion_reason(F.col("raw_fields"), mapping, 1.0, 1e3, 1e3).alias("reason"))


@query(f"""WITH r AS ({_REASON}) SELECT user_id, count(*) AS lines, count(*) FILTER (reason IS NULL) AS included, count(*) FILTER (reason IS NOT NULL) AS excluded,
  string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM r GROUP BY user_id""")
def row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"frequency": 0, "zreal": 1, "zimag": 2, "valid": 3}
    r = _raw_rows(spark, sf_dir).withColumn("reason", exclusion_reason(F.col("raw_fields"), mapping, 1.0, 1e3, 1e3))
    names = F.array_join(F.array_sort(F.collect_set("reason")), "|")
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("included"), F.count("reason").alias("excluded"), names.alias("reasons")).withColumn("reasons", F.when(F.col("reasons") != "", F.col("reasons")))


@query("""WITH s AS (SELECT source, min(lang) AS lang, max(doc_id)::VARCHAR AS protocol FROM documents GROUP BY source)
SELECT d.doc_id, s.lang AS lang, s.protocol AS protocol, l.quality::VARCHAR AS quality, coalesce(l.toxic::VARCHAR, '9') AS toxic FROM documents d JOIN s USING (source) LEFT JOIN labels l USING (doc_id)""")
def manifest_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents")
    pairs = lambda **c: F.map_from_arrays(F.array(*[F.lit(k) for k in c]), F.array(*c.values()))
    by_source = d.groupBy("source").agg(F.min("lang").alias("lang"), F.max("doc_id").cast("string").alias("p")).select("source", pairs(lang=F.col("lang"), protocol=F.col("p"), toxic=F.lit("9")).alias("metadata"))
    exact = B.read(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").select("source", "doc_id", pairs(quality=F.col("quality").cast("string"), toxic=F.col("toxic").cast("string")).alias("metadata"))
    m = T.overlay(d.select("source", "doc_id"), by_source, exact, "source", "doc_id")
    return m.select("doc_id", *[F.col("metadata")[k].alias(k) for k in ("lang", "protocol", "quality", "toxic")])


@query("""SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)""")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "labels").select("doc_id").join(B.read(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 4 <> 0 AND doc_id % 3 <> 2""")
def inventory_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").join(B.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    include = F.when(F.col("doc_id") % 4 == 0, " No ").otherwise("")
    role = F.when(F.col("doc_id") % 3 == 0, "EIS").when(F.col("doc_id") % 3 == 2, "ocv")
    return d.where(T.row_selected(include, role)).select("doc_id", "source")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    k = F.col("k")
    return c.select("k", F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("cell_id", "temperature_c", "potential_v", "target_voltage_v", "hold_time_s", "ocv_rest_s", "state", "cycle")]),
        F.array((k % 50).cast("string"), F.concat((k % 9).cast("string"), F.lit(".50")), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("3.700")), F.lit("4.20"), (k % 4).cast("string"), F.when(k % 6 == 0, F.lit("7")).otherwise((k % 4).cast("string")), F.col("c_mktsegment"), F.when(k % 5 == 0, F.lit("first")).otherwise(F.lit("2.0"))),
    ).alias("metadata"))


_META = """SELECT c_custkey AS k, (c_custkey % 50)::VARCHAR AS cell_id, CASE WHEN c_custkey % 9 = 0 THEN '0.5' ELSE (c_custkey % 9) || '.5' END AS temperature, CASE WHEN c_custkey % 3 = 0 THEN '4.2' ELSE '3.7' END AS voltage,
  CASE WHEN c_custkey % 6 = 0 AND c_custkey % 4 <> 7 THEN NULL ELSE (c_custkey % 4)::VARCHAR END AS rest, CASE WHEN c_custkey % 5 = 0 THEN 'first' ELSE '2' END AS cycle, c_mktsegment AS state,
  CASE WHEN c_custkey % 6 = 0 THEN 'rest_time_s' ELSE '' END AS conflicts FROM customer"""


@query(_META)
def canonical_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.canonical(_meta(spark, sf_dir), "k", "metadata")
    v = F.col("canonical")
    return m.select("k", v["cell_id"].alias("cell_id"), v["temperature_C"].alias("temperature"), v["voltage_v"].alias("voltage"), v["rest_time_s"].alias("rest"), v["cycle"].alias("cycle"), v["state"].alias("state"), F.array_join("conflicts", ",").alias("conflicts"))


@query(f"""WITH m AS ({_META}) SELECT 'cell_id=' || cell_id || '|state=' || state || '|voltage_v=' || voltage || '|temperature_C=' || temperature || '|cycle=' || cycle || coalesce('|rest_time_s=' || rest, '') AS group_id, count(*) AS members FROM m GROUP BY ALL HAVING count(*) >= 2""")
def condition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.canonical(_meta(spark, sf_dir), "k", "metadata")
    return m.select(M.group_id(F.col("canonical"), "repeat").alias("group_id")).where("group_id IS NOT NULL").groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")


_E = "e AS (SELECT user_id, event_id, 1 + value AS x, epoch_us(ts) / 1e6 AS t, lag(1 + value) OVER w AS x0, lag(epoch_us(ts) / 1e6) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").select("user_id", "event_id", (1 + F.col("value")).alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query(f"""WITH {_E}, m AS (SELECT user_id, median(log10(x) - log10(x0)) FILTER (abs(log10(x) - log10(x0)) > 1e-12) AS d FROM e GROUP BY user_id),
c AS (SELECT e.user_id, event_id, CASE WHEN x0 IS NULL OR d IS NULL THEN 0 WHEN d < 0 THEN (x > x0 * 1.2e0)::INT ELSE (x < x0 / 1.2e0)::INT END AS cut FROM e JOIN m USING (user_id))
SELECT user_id, event_id, 1 + sum(cut) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM c""")
def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sweep_runs(_sequence(spark, sf_dir), "user_id", "event_id", "x").select("user_id", "event_id", F.col("run").cast("bigint").alias("run"))


@query(f"""WITH {_E}, d AS (SELECT *, sign(x - x0) AS s, lag(sign(x - x0)) OVER (PARTITION BY user_id ORDER BY event_id) AS s0, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
SELECT user_id, count(*) AS points, count(*) - count(DISTINCT x) AS duplicate_frequencies, count(*) FILTER (s <> s0) AS direction_changes, count(*) FILTER (g > 1.000001) AS index_gaps,
  CASE WHEN count(*) FILTER (s <> s0) > 0 OR count(*) FILTER (g > 1.000001) > 0 THEN 'suspect' ELSE 'pass' END AS status FROM d GROUP BY user_id""")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sequence(spark, sf_dir).withColumn("n", F.col("event_id").cast("double"))
    return Q.quality_counts(p, "user_id", "event_id", "x", "n")


@query(f"""WITH {_E}, s AS (SELECT user_id, event_id, t - t0 AS step FROM e WHERE t0 IS NOT NULL),
r AS (SELECT a.user_id, a.event_id, a.step, (SELECT median(b.step) FROM (SELECT step, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM s) b WHERE b.user_id = a.user_id AND b.n <> a.n AND abs(b.n - a.n) <= 3 AND b.step > 0) AS reference
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM s) a)
SELECT user_id, event_id, round(step, 3) + 0e0 AS step, round(reference, 3) + 0e0 AS reference, step <= 0 OR coalesce(step > 3 * reference, false) AS anomalous FROM r""")
def time_step_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.time_steps(_sequence(spark, sf_dir), "user_id", "event_id", "t").select("user_id", "event_id", r6("step", 3).alias("step"), r6("reference", 3).alias("reference"), "anomalous")


@query(f"""WITH {B.SQL}, f AS (SELECT uid, i, neg_zimag < 0.05 AS f, sum((NOT neg_zimag < 0.05)::INT) OVER (PARTITION BY uid ORDER BY i) AS g FROM p)
SELECT uid, max(n)::BIGINT AS longest FROM (SELECT uid, g, count(*) FILTER (f) AS n FROM f GROUP BY uid, g) GROUP BY uid""")
def longest_negative_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.longest_run(B.points(spark, sf_dir), F.col("neg_zimag") < 0.05, F.col("i"))


@query(f"""WITH {_E}, n AS (SELECT user_id, x, lead(x) OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM e)
SELECT user_id, CASE WHEN count(*) >= 4 AND stddev_pop(x) FILTER (y IS NOT NULL) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) + 0e0 END AS lag1 FROM n GROUP BY user_id""")
def lag1_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lag1(_sequence(spark, sf_dir), "user_id", "event_id", "x").select("user_id", r6("lag1").alias("lag1"))


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("i") / 60.0 - 0.5
    return B.points(spark, sf_dir).withColumns({"fit_zreal": F.col("zreal") * (1 + 0.001 * (F.col("uid") % 7) * x), "fit_neg_zimag": F.col("neg_zimag") * (1 - 0.0005 * (F.col("i") % 3))})


_PERTURBED = B.SQL + ", v AS (SELECT *, zreal * (1 + 0.001e0 * (uid % 7) * (i / 60e0 - 0.5e0)) AS a, neg_zimag * (1 - 0.0005e0 * (i % 3)) AS b FROM p)"


@query(f"""WITH {_PERTURBED}, m AS (SELECT *, sqrt(zreal * zreal + neg_zimag * neg_zimag) AS m, (sqrt(zreal * zreal + neg_zimag * neg_zimag) + sqrt(a * a + b * b)) / 2 AS h FROM v)
SELECT uid, round(100 * sqrt(avg(((a - zreal) / m) ^ 2)), 6) + 0e0 AS component_rms_re_percent, round(100 * sqrt(avg(((b - neg_zimag) / m) ^ 2)), 6) + 0e0 AS component_rms_im_percent,
  round(100 * sqrt(avg(((a - zreal) / m) ^ 2 + ((b - neg_zimag) / m) ^ 2)), 6) + 0e0 AS relative_complex_rms_percent, round(log10(sqrt(avg(((a - zreal) / m) ^ 2 + ((b - neg_zimag) / m) ^ 2) / 2)), 6) + 0e0 AS quality_log10,
  round(100 * sqrt(avg(((a - zreal) / h) ^ 2 + ((b - neg_zimag) / h) ^ 2)), 6) + 0e0 AS symmetric_rms_percent FROM m GROUP BY uid""")
def rms_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.residual_measures(_perturbed(spark, sf_dir))
    return s.select("uid", *[r6(c).alias(c) for c in s.columns[1:]])


@query(f"""WITH {B.SQL}, m AS (SELECT uid, max(frequency_hz) AS fmax, 0.002e0 * quantile_cont(abs(neg_zimag), 0.75) AS t FROM p GROUP BY uid)
SELECT uid, count(*) FILTER (frequency_hz >= fmax / 10) AS n_high, count(*) FILTER (frequency_hz >= fmax / 10 AND neg_zimag < -t) AS n_negative, round(any_value(t), 8) + 0e0 AS threshold,
  count(*) FILTER (frequency_hz >= fmax / 10) >= 3 AND count(*) FILTER (frequency_hz >= fmax / 10 AND neg_zimag < -t) >= 3 AS detected FROM p JOIN m USING (uid) GROUP BY uid""")
def hf_inductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.high_frequency_inductance(B.points(spark, sf_dir)).withColumn("threshold", r6("threshold", 8))


_SERIES = """m AS (SELECT uid, max(frequency_hz) AS fmax FROM p GROUP BY uid),
sl AS (SELECT uid, count(*) AS n_high, greatest(0e0, -regr_slope(neg_zimag, 2 * pi() * frequency_hz)) AS l, regr_r2(neg_zimag, 2 * pi() * frequency_hz) AS r2 FROM p JOIN m USING (uid) WHERE frequency_hz >= fmax / 10 GROUP BY uid)"""


@query(f"""WITH {B.SQL}, {_SERIES} SELECT uid, n_high, round(l * 1e6, 6) + 0e0 AS inductance_uh, round(r2, 6) + 0e0 AS r_squared, l > 0 AND r2 >= 0.9 AS explainable FROM sl""")
def series_l_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.series_inductance(B.points(spark, sf_dir))
    return s.select("uid", "n_high", r6(F.col("inductance_h") * 1e6).alias("inductance_uh"), r6("r_squared").alias("r_squared"), "explainable")


def _with_rl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points() with an RL lobe at low frequency for every fourth key."""
    x = F.lit(2 * 3.141592653589793) * F.col("frequency_hz") * 2.0
    on = F.when(F.col("uid") % 4 == 1, 8.0).otherwise(0.0)
    return B.points(spark, sf_dir).withColumns({"zreal": F.col("zreal") + on * x * x / (1 + x * x), "neg_zimag": F.col("neg_zimag") - on * x / (1 + x * x)})


_RL = """rl AS (SELECT uid, i, frequency_hz, zreal + CASE WHEN uid % 4 = 1 THEN 8e0 ELSE 0 END * (2 * pi() * frequency_hz * 2) ^ 2 / (1 + (2 * pi() * frequency_hz * 2) ^ 2) AS zreal,
  neg_zimag - CASE WHEN uid % 4 = 1 THEN 8e0 ELSE 0 END * (2 * pi() * frequency_hz * 2) / (1 + (2 * pi() * frequency_hz * 2) ^ 2) AS neg_zimag FROM p)"""


@query(f"""WITH {B.SQL}, {_RL}, m AS (SELECT uid, max(frequency_hz) AS fmax, 0.002e0 * quantile_cont(abs(neg_zimag), 0.75) AS t, median(sqrt(zreal * zreal + neg_zimag * neg_zimag)) * 1e-12 AS fl FROM rl GROUP BY uid),
sl AS (SELECT uid, CASE WHEN -regr_slope(neg_zimag, 2 * pi() * frequency_hz) > 0 AND regr_r2(neg_zimag, 2 * pi() * frequency_hz) >= 0.9 THEN -regr_slope(neg_zimag, 2 * pi() * frequency_hz) ELSE 0 END AS l FROM rl JOIN m USING (uid) WHERE frequency_hz >= fmax / 10 GROUP BY uid),
y AS (SELECT rl.uid, i, frequency_hz < fmax / 10 AS low, t, ln(frequency_hz) AS x, neg_zimag + 2 * pi() * frequency_hz * l AS y, greatest(sqrt(zreal * zreal + neg_zimag * neg_zimag), fl) AS m FROM rl JOIN m USING (uid) JOIN sl USING (uid)),
w AS (SELECT *, lag(x) OVER o AS x0, lead(x) OVER o AS x2, lag(y / m) OVER o AS v0, lead(y / m) OVER o AS v2 FROM y WINDOW o AS (PARTITION BY uid ORDER BY i)),
r AS (SELECT *, (y / m - (x2 - x) / (x2 - x0) * v0 - (1 - (x2 - x) / (x2 - x0)) * v2) / sqrt(1 + ((x2 - x) / (x2 - x0)) ^ 2 + (1 - (x2 - x) / (x2 - x0)) ^ 2) AS e FROM w),
s AS (SELECT uid, 1.4826e0 * mad(e) AS s FROM r GROUP BY uid),
f AS (SELECT r.uid, i, low AND y < -greatest(t, 3 * s * m) AS f FROM r JOIN s USING (uid)),
g AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY uid ORDER BY i) AS g FROM f)
SELECT uid, sum(n)::BIGINT AS n_negative, max(n)::BIGINT AS longest, max(n) >= 3 AS detected FROM (SELECT uid, g, count(*) FILTER (f) AS n FROM g GROUP BY uid, g) GROUP BY uid""")
def nonseries_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nonseries_inductance(_with_rl(spark, sf_dir)).select("uid", F.col("n_negative").cast("bigint").alias("n_negative"), F.col("longest").cast("bigint").alias("longest"), "detected")


def _with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("uid") % 3 == 0, 2.0).otherwise(0.0) / F.sqrt(F.lit(2.0) * 2 * 3.141592653589793 * F.col("frequency_hz"))
    return B.points(spark, sf_dir).withColumns({"zreal": F.col("zreal") + s, "neg_zimag": F.col("neg_zimag") + s})


_TAIL = "tl AS (SELECT uid, i, frequency_hz, zreal + s AS zreal, neg_zimag + s AS neg_zimag FROM (SELECT *, CASE WHEN uid % 3 = 0 THEN 2e0 ELSE 0 END / sqrt(2 * 2 * pi() * frequency_hz) AS s FROM p))"


@query(f"""WITH {B.SQL}, {_TAIL}, r AS (SELECT *, sqrt(zreal * zreal + neg_zimag * neg_zimag) AS m, row_number() OVER (PARTITION BY uid ORDER BY frequency_hz) AS k, count(*) OVER (PARTITION BY uid) AS n FROM tl),
d AS (SELECT uid, median(m) AS mid FROM r GROUP BY uid),
s AS (SELECT uid, count(*) AS n_low, (max(neg_zimag) - min(neg_zimag)) / (max(zreal) - min(zreal)) AS ny, regr_slope(log10(m), log10(frequency_hz)) AS ms, median(neg_zimag) AS y, max(m) - min(m) AS gr FROM r WHERE k <= greatest(5, ceil(0.18e0 * n)) GROUP BY uid)
SELECT uid, n_low, round(ms, 6) + 0e0 AS magnitude_slope, y > 0 AND (ny BETWEEN 0.15 AND 8 OR ms < -0.2) AND gr > 0.02e0 * mid AS detected FROM s JOIN d USING (uid)""")
def diffusion_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diffusion_tail(_with_tail(spark, sf_dir)).select("uid", F.col("n_low").cast("bigint").alias("n_low"), r6("magnitude_slope").alias("magnitude_slope"), "detected")


@query(f"""WITH {_PERTURBED}, m AS (SELECT uid, i / 60e0 - 0.5e0 AS x, (zreal - a) / sqrt(zreal * zreal + neg_zimag * neg_zimag) AS re, (b - neg_zimag) / sqrt(zreal * zreal + neg_zimag * neg_zimag) AS im FROM v),
s AS (SELECT uid, count(*) AS n, 100 * sqrt(regr_slope(re, x) ^ 2 + regr_slope(im, x) ^ 2) AS span, 100 * sqrt(avg(re * re + im * im)) AS rms,
  100 * sqrt(greatest(var_pop(re) + var_pop(im) - (regr_slope(re, x) ^ 2 + regr_slope(im, x) ^ 2) * var_pop(x), 0)) AS rest FROM m GROUP BY uid)
SELECT uid, CASE WHEN span > 0.5 AND span > 1.5e0 * rest THEN 'structured-drift-suspect' ELSE 'no-strong-monotonic-drift' END AS status, round(span, 6) + 0e0 AS trend_span_percent, round(rest, 5) + 0e0 AS detrended_rms_percent, round(rms, 6) + 0e0 AS residual_rms_percent FROM s""")
def drift_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drift_screen(_perturbed(spark, sf_dir)).select("uid", "status", r6("trend_span_percent").alias("trend_span_percent"), r6("detrended_rms_percent", 5).alias("detrended_rms_percent"), r6("residual_rms_percent").alias("residual_rms_percent"))


@query(f"""WITH {B.SQL}, {_TAIL}, m AS (SELECT uid, max(frequency_hz) AS hi, min(frequency_hz) AS lo FROM tl GROUP BY uid),
s AS (SELECT uid, count(*) FILTER (frequency_hz >= hi / 10 AND neg_zimag < 0) >= 3 AS series_l, count(*) FILTER (frequency_hz <= lo * pow(10e0, 1.5e0) AND neg_zimag > 0) AS n,
  regr_slope(log10(neg_zimag), log10(frequency_hz)) FILTER (frequency_hz <= lo * pow(10e0, 1.5e0) AND neg_zimag > 0) AS c FROM tl JOIN m USING (uid) GROUP BY uid)
SELECT uid, series_l, coalesce(n >= 4 AND c BETWEEN -1.35 AND -0.65, false) AS series_c, CASE WHEN n >= 4 THEN round(c, 6) + 0e0 END AS c_slope FROM s""")
def nuisance_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nuisance_eligibility(_with_tail(spark, sf_dir).withColumn("neg_zimag", F.col("neg_zimag"))).select("uid", "series_l", "series_c", r6("c_slope").alias("c_slope"))


_CURVE = "cv AS (SELECT vec_id, j, exp(j / 8e0) AS tau, (embedding[j + 1] + 0.001e0 * j)::DOUBLE AS g FROM (SELECT vec_id, embedding, unnest(range(len(embedding)))::INT AS j FROM embeddings))"


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return e.select("vec_id", "j", F.exp(F.col("j") / 8.0).alias("tau"), (F.col("v").cast("double") + 0.001 * F.col("j")).alias("g"))


_BASINS = _CURVE + """, n AS (SELECT *, lag(g) OVER w AS g0, lead(g) OVER w AS g2, count(*) OVER (PARTITION BY vec_id) AS n FROM cv WINDOW w AS (PARTITION BY vec_id ORDER BY j)),
tp AS (SELECT vec_id, j, g, n, row_number() OVER (PARTITION BY vec_id ORDER BY j) AS k, lead(j) OVER (PARTITION BY vec_id ORDER BY j) AS jn, max(g) OVER (PARTITION BY vec_id) AS top FROM n WHERE (g0 IS NULL AND g > g2) OR (g2 IS NULL AND g > g0) OR (g > g0 AND g >= g2)),
ct AS (SELECT vec_id, k, (SELECT min_by(c.j, (c.g, c.j)) FROM cv c WHERE c.vec_id = tp.vec_id AND c.j BETWEEN tp.j AND tp.jn) AS cut FROM tp WHERE jn IS NOT NULL),
bs AS (SELECT tp.vec_id, tp.k, tp.j, tp.g, tp.top, coalesce(a.cut, 0) AS lo, coalesce(b.cut, tp.n - 1) AS hi FROM tp LEFT JOIN ct a ON a.vec_id = tp.vec_id AND a.k = tp.k - 1 LEFT JOIN ct b ON b.vec_id = tp.vec_id AND b.k = tp.k),
bf AS (SELECT *, CASE WHEN hi <= lo THEN least(lo + 1, 63) ELSE hi END AS h FROM bs)"""


@query(f"""WITH {_BASINS}, ar AS (SELECT bf.vec_id, k, sum((c.g + c.g0) / 2 / 8e0) AS area FROM bf JOIN n c ON c.vec_id = bf.vec_id AND c.j > lo AND c.j <= h GROUP BY ALL)
SELECT vec_id, (k - 1)::BIGINT AS peak, j::INT AS index, round(g, 6) + 0e0 AS gamma, round(g / top, 6) + 0e0 AS relative_height, round(greatest(area, 0), 6) + 0e0 AS area, round(lo / 8e0, 6) + 0e0 AS ln_tau_min, round(h / 8e0, 6) + 0e0 AS ln_tau_max FROM bf JOIN ar USING (vec_id, k)""")
def peak_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Q.peak_basins(_curves(spark, sf_dir), "vec_id", "tau", "g")
    return b.select("vec_id", F.col("peak").cast("bigint").alias("peak"), "index", r6("gamma").alias("gamma"), r6("relative_height").alias("relative_height"), r6("area").alias("area"), r6(F.log("basin_tau_min_s")).alias("ln_tau_min"), r6(F.log("basin_tau_max_s")).alias("ln_tau_max"))


@query(f"""WITH {_BASINS}, wn AS (SELECT *, greatest(lo / 8e0, 1.03e0) AS a, least(h / 8e0, 6.05e0) AS b FROM bf),
sg AS (SELECT wn.vec_id, k, greatest(a, (c.j - 1) / 8e0) AS u, least(b, c.j / 8e0) AS v, c.g0, c.g, c.j FROM wn JOIN n c ON c.vec_id = wn.vec_id AND c.j >= 1),
ar AS (SELECT vec_id, k, greatest(sum(CASE WHEN v > u THEN (v - u) * (g0 + (g - g0) * (u - (j - 1) / 8e0) * 8 + g0 + (g - g0) * (v - (j - 1) / 8e0) * 8) / 2 ELSE 0 END), 0) AS area FROM sg GROUP BY ALL)
SELECT vec_id, (k - 1)::BIGINT AS peak, round(area, 6) + 0e0 AS in_window_area, CASE WHEN j / 8e0 BETWEEN 1.03 AND 6.05 THEN round(area, 6) + 0e0 END AS area_impedance, lo / 8e0 >= 1.03e0 AND h / 8e0 <= 6.05e0 AS area_supported,
  round(CASE WHEN b > a THEN least((b - a) / ((h - lo) / 8e0), 1) ELSE 0 END, 6) + 0e0 AS basin_window_fraction FROM wn JOIN ar USING (vec_id, k)""")
def peak_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir).withColumns({"fmin": 1 / (2 * 3.141592653589793 * F.exp(F.lit(6.05))), "fmax": 1 / (2 * 3.141592653589793 * F.exp(F.lit(1.03)))})
    p = Q.peak_support(Q.peak_basins(c, "vec_id", "tau", "g"), c, "vec_id", "tau", "g")
    return p.select("vec_id", F.col("peak").cast("bigint").alias("peak"), *[r6(x).alias(x) for x in ("in_window_area", "area_impedance")], "area_supported", r6("basin_window_fraction").alias("basin_window_fraction"))


@query(f"""WITH {_CURVE}, n AS (SELECT vec_id, j, g, lag(g) OVER w AS b, lead(g) OVER w AS a, max(g) OVER (PARTITION BY vec_id) AS hi, max(-g) OVER (PARTITION BY vec_id) AS lo FROM cv WINDOW w AS (PARTITION BY vec_id ORDER BY j))
SELECT vec_id, 'RC-positive' AS branch, round(j / 8e0, 6) AS ln_tau, round(g, 6) + 0e0 AS gamma FROM n WHERE hi > 0 AND g >= 0.03e0 * hi AND g >= b AND g > a
UNION ALL SELECT vec_id, 'RL-negative', round(j / 8e0, 6), round(g, 6) + 0e0 FROM n WHERE lo > 0 AND -g >= 0.03e0 * lo AND -g >= -b AND -g > -a""")
def signed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.signed_peaks(_curves(spark, sf_dir), "vec_id", "tau", "g").select("vec_id", "branch", r6(F.log("tau_s")).alias("ln_tau"), r6("gamma").alias("gamma"))


@query(f"""WITH {_CURVE}, n AS (SELECT vec_id, g, lag(g) OVER (PARTITION BY vec_id ORDER BY j) AS g0 FROM cv) SELECT vec_id, round(greatest(sum((g + g0) / 2 / 8e0), 0), 6) + 0e0 AS area FROM n GROUP BY vec_id""")
def gamma_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gamma_area(_curves(spark, sf_dir), "vec_id", "tau", "g").withColumn("area", r6("area"))


@query("""WITH c AS (SELECT vec_id, j, list_distinct(list_transform(range(20), lambda r: round_even(r * (len(embedding) - 1) / 19e0, 0)::INT)) AS keep FROM (SELECT vec_id, embedding, unnest(range(len(embedding)))::INT AS j FROM embeddings))
SELECT vec_id, j FROM c WHERE list_contains(keep, j)""")
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.even_sample(_curves(spark, sf_dir), "vec_id", "j", 20).select("vec_id", "j")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.control_spectra(spark, sf_dir)
    text = lambda x: F.col(x).cast("string")
    meta = lambda *more: F.map_from_arrays(F.array(*[F.lit(k) for k in ("cell_id", "state", "replicate", *more)]), F.array(text("cell"), F.lit("full"), text("replicate"), *[text({"ac_amplitude_mv": "amplitude_mv"}.get(m, m)) for m in more]))
    return c.withColumns({"repeat_id": M.group_id(meta(), "repeat"), "linearity_id": M.group_id(meta("ac_amplitude_mv"), "linearity"), "stationarity_id": M.group_id(meta("rest_time_s"), "stationarity")})


_PAIRS = B.CONTROL_SQL + """, pr AS (SELECT a.cell, a.uid AS u1, b.uid AS u2, a.amplitude_mv AS a1, b.amplitude_mv AS a2, a.rest_time_s AS s1, b.rest_time_s AS s2,
  sqrt(avg((100 * sqrt((b.zreal - a.zreal) ^ 2 + (b.neg_zimag - a.neg_zimag) ^ 2) / ((sqrt(a.zreal ^ 2 + a.neg_zimag ^ 2) + sqrt(b.zreal ^ 2 + b.neg_zimag ^ 2)) / 2)) ^ 2)) AS rms, count(*) AS n,
  median(100 * sqrt((b.zreal - a.zreal) ^ 2 + (b.neg_zimag - a.neg_zimag) ^ 2) / ((sqrt(a.zreal ^ 2 + a.neg_zimag ^ 2) + sqrt(b.zreal ^ 2 + b.neg_zimag ^ 2)) / 2)) AS med,
  max(100 * sqrt((b.zreal - a.zreal) ^ 2 + (b.neg_zimag - a.neg_zimag) ^ 2) / ((sqrt(a.zreal ^ 2 + a.neg_zimag ^ 2) + sqrt(b.zreal ^ 2 + b.neg_zimag ^ 2)) / 2)) AS mx
  FROM cp a JOIN cp b ON a.cell = b.cell AND a.uid < b.uid AND a.i = b.i GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT u1 AS uid_1, u2 AS uid_2, 'completed' AS status, n AS common_points, round(rms, 6) + 0e0 AS rms_percent, round(med, 6) + 0e0 AS median_percent, round(mx, 6) + 0e0 AS max_percent FROM pr")
def pair_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.compare(C.pairs_within(_grouped(spark, sf_dir), "repeat_id"))
    return p.select("uid_1", "uid_2", "status", F.col("common_points").cast("bigint").alias("common_points"), *[r6(c).alias(c) for c in ("rms_percent", "median_percent", "max_percent")])


@query("""SELECT s_suppkey AS uid, CASE s_suppkey % 4 WHEN 0 THEN 61 WHEN 1 THEN 61 WHEN 2 THEN 0 ELSE 60 END::BIGINT AS aligned, s_suppkey % 4 <> 2 AS comparable FROM supplier""")
def grid_align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids shifted by nothing, by less than the tolerance, by more, and cut by a point."""
    s = B.spectra(B.points(spark, sf_dir))
    shift = F.when(F.col("uid") % 4 == 1, 1 + 1e-5).when(F.col("uid") % 4 == 2, 1.03).otherwise(1.0)
    moved = F.transform("points", lambda p: F.struct((p["frequency_hz"] * shift).alias("frequency_hz"), p["zreal"].alias("zreal"), p["neg_zimag"].alias("neg_zimag")))
    cut = F.when(F.col("uid") % 4 == 3, F.slice(moved, 1, B.POINTS - 1)).otherwise(moved)
    p = s.select(F.col("uid").alias("uid_1"), F.col("uid").alias("uid_2"), F.lit("ohm").alias("basis_1"), F.lit("ohm").alias("basis_2"), F.col("points").alias("points_1"), cut.alias("points_2"))
    c = C.compare(p)
    return c.select(F.col("uid_1").alias("uid"), F.size(C.align(F.col("points_1"), F.col("points_2"))).cast("bigint").alias("aligned"), (F.col("status") == "completed").alias("comparable"))


_REPEAT = _PAIRS + """, rg AS (SELECT cell, max(rms) AS mx, count(*) AS np FROM pr GROUP BY cell),
ng AS (SELECT s_suppkey // 4 AS cell, count(*) AS members FROM supplier GROUP BY ALL HAVING count(*) >= 2),
ms AS (SELECT cell, uid, CASE WHEN members = 3 THEN min(rms) ELSE median(rms) END AS score FROM (SELECT cell, u1 AS uid, rms FROM pr UNION ALL SELECT cell, u2, rms FROM pr) JOIN ng USING (cell) WHERE members >= 3 GROUP BY cell, uid, members),
mc AS (SELECT cell, median(score) AS c, mad(score) AS m FROM ms GROUP BY cell),
mo AS (SELECT ms.cell, uid, score, CASE WHEN m > 1e-12 THEN 0.6745e0 * (score - c) / m END AS z, score > 2 AND CASE WHEN m > 1e-12 THEN 0.6745e0 * (score - c) / m > 3.5 ELSE score > greatest(2, 3 * c) END AS outlier FROM ms JOIN mc USING (cell)),
rs AS (SELECT 'cell_id=' || ng.cell || '|state=full' AS grp, ng.cell, members, CASE WHEN coalesce(o, false) THEN 'repeat-outlier-detected' WHEN mx > 2 THEN 'repeat-disagreement' ELSE 'repeat-peak-not-assessable' END AS status, mx FROM ng JOIN rg USING (cell) LEFT JOIN (SELECT cell, bool_or(outlier) AS o FROM mo GROUP BY cell) USING (cell))"""


@query(f"WITH {_REPEAT} SELECT grp, members, status, round(mx, 6) + 0e0 AS max_rms_percent FROM rs")
def repeat_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeat_assessment(_grouped(spark, sf_dir))[0].withColumn("max_rms_percent", r6("max_rms_percent"))


@query(f"WITH {_REPEAT} SELECT uid, round(score, 6) + 0e0 AS score, outlier FROM mo")
def repeat_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeat_assessment(_grouped(spark, sf_dir))[1].select("uid", r6("score").alias("score"), "outlier")


_FOUND = """, fk AS (SELECT s_suppkey AS uid, s_suppkey // 4 AS cell, s_suppkey % 4 AS rep FROM supplier),
fp AS (SELECT a.uid AS u1, b.uid AS u2, CASE a.cell % 3 WHEN 1 THEN 'not-assessable' WHEN 2 THEN CASE WHEN 3 IN (a.rep, b.rep) THEN 'changed-materially' ELSE 'accepted' END ELSE 'accepted' END AS peak_status FROM fk a JOIN fk b ON a.cell = b.cell AND a.uid < b.uid)"""


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the control spectra: one at 10 Hz, that in each third cell is at 100 Hz in the fourth replicate, and one of low signal
    that wanders; each third cell has no other."""
    keys = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"))
    cell, fourth = F.floor(F.col("uid") / 4), F.col("uid") % 4 == 3
    peak = lambda f, h, c: F.struct(f.alias("frequency_hz"), F.lit(h).alias("relative_height"), F.lit(1.0).alias("area_impedance"), F.lit(c).alias("confidence"))
    minor = peak(F.pow(F.lit(10.0), (F.col("uid") % 4).cast("double")), 0.01, "minor-low-signal")
    high = peak(F.when((cell % 3 == 2) & fourth, 100.0).otherwise(10.0), 1.0, "resolved")
    return keys.select("uid", F.explode(F.when(cell % 3 == 1, F.array(minor)).otherwise(F.array(high, minor))).alias("p")).select("uid", "p.*")


@query(f"WITH {_FOUND[2:]} SELECT u1 AS uid_1, u2 AS uid_2, peak_status FROM fp")
def repeat_peak_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeat_peak_status(_grouped(spark, sf_dir), _peaks(spark, sf_dir))


@query(f"""WITH {_REPEAT}{_FOUND}, fg AS (SELECT u1 // 4 AS cell, bool_or(peak_status = 'changed-materially') AS changed, bool_or(peak_status <> 'accepted') AS unsure FROM fp GROUP BY ALL)
SELECT grp, members, CASE WHEN status <> 'repeat-peak-not-assessable' THEN status WHEN changed THEN 'repeat-peak-disagreement' WHEN unsure THEN status WHEN members >= 3 THEN 'repeat-supported' ELSE 'pair-only' END AS status FROM rs JOIN fg USING (cell)""")
def repeat_with_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _grouped(spark, sf_dir)
    return C.repeat_assessment(s, peaks=C.repeat_peak_status(s, _peaks(spark, sf_dir)))[0].select("grp", "members", "status")


_LINEAR = """, ln AS (SELECT 'cell_id=' || cell || '|state=full' AS grp, cell, mx, members, levels FROM (SELECT cell, count(*) AS members, count(DISTINCT amplitude_mv) AS levels FROM c_k GROUP BY cell HAVING count(DISTINCT amplitude_mv) >= 2) JOIN (SELECT cell, max(rms) AS mx FROM pr GROUP BY cell) USING (cell)),
ls AS (SELECT grp, cell, members, levels, CASE WHEN mx <= 2 THEN 'linearity-supported' ELSE 'amplitude-dependent' END AS status, mx FROM ln)"""


@query(f"WITH {_PAIRS}{_LINEAR} SELECT grp, members, levels, status, round(mx, 6) + 0e0 AS max_rms_percent FROM ls")
def linearity_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.linearity_assessment(_grouped(spark, sf_dir)).withColumn("max_rms_percent", r6("max_rms_percent"))


_STATION = """, lv AS (SELECT k AS uid, cell, dense_rank() OVER (PARTITION BY cell ORDER BY rest_time_s) AS r FROM c_k),
lm AS (SELECT cell, max(r) AS levels FROM lv GROUP BY cell HAVING max(r) >= 2),
lp AS (SELECT pr.cell, levels, max(rms) AS mx FROM pr JOIN lm USING (cell) JOIN lv a ON a.uid = u1 JOIN lv b ON b.uid = u2 WHERE a.r >= levels - 1 AND b.r >= levels - 1 GROUP BY ALL),
st AS (SELECT 'cell_id=' || cell || '|state=full' AS grp, cell, levels, CASE WHEN levels = 2 THEN 'two-rest-discrepancy-only' WHEN mx <= 2 THEN 'rest-stable' ELSE 'rest-dependent' END AS status, mx FROM lp)"""


@query(f"WITH {_PAIRS}{_STATION} SELECT grp, levels::INT AS levels, status, round(mx, 6) + 0e0 AS last_rms_percent FROM st")
def stationarity_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stationarity_assessment(_grouped(spark, sf_dir))[0].withColumn("last_rms_percent", r6("last_rms_percent"))


_EVIDENCE = _REPEAT + _LINEAR + _STATION + """, ev AS (SELECT k AS uid, CASE WHEN rs.status IN ('repeat-disagreement', 'repeat-outlier-detected') THEN 'contradicted' WHEN rs.status = 'repeat-supported' THEN 'supported' ELSE 'evidence-missing' END AS repeat,
  CASE ls.status WHEN 'amplitude-dependent' THEN 'contradicted' WHEN 'linearity-supported' THEN 'supported' ELSE 'evidence-missing' END AS linearity,
  CASE WHEN st.status = 'rest-dependent' THEN 'contradicted' WHEN st.status = 'rest-stable' AND lv.r >= st.levels - 1 THEN 'supported' ELSE 'evidence-missing' END AS stationarity
  FROM c_k LEFT JOIN rs USING (cell) LEFT JOIN ls USING (cell) LEFT JOIN st USING (cell) JOIN lv ON lv.uid = k),
es AS (SELECT *, CASE WHEN 'contradicted' IN (repeat, linearity, stationarity) THEN 'contradicted' WHEN repeat = 'supported' AND linearity = 'supported' AND stationarity = 'supported' THEN 'supported' ELSE 'evidence-missing' END AS evidence_status FROM ev)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _grouped(spark, sf_dir)
    groups, late = C.stationarity_assessment(s)
    return C.evidence(s, C.repeat_assessment(s)[0], C.linearity_assessment(s), groups, late)


@query(f"WITH {_EVIDENCE} SELECT * FROM es")
def per_spectrum_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


def _results(e: DataFrame) -> DataFrame:
    u = F.col("uid")
    none = F.lit(None)
    return e.select(
        "uid", (u % 13 != 0).alias("completed"), F.when(u % 5 == 0, "warn").otherwise("screen-pass").alias("kk_status"), (u % 17 == 0).alias("kk_subset"), (u % 19 == 0).alias("lambda_boundary"),
        F.when(u % 23 != 0, 0.5).alias("rms_re_percent"), F.when(u % 7 == 0, 3.0).otherwise(0.5).alias("rms_im_percent"), none.cast("string").alias("drift_status"), (u % 29 == 0).alias("nonseries"), F.lit(False).alias("diffusion"),
        none.cast("string").alias("signed_status"), none.cast("string").alias("signed_sensitivity"), none.cast("boolean").alias("signed_lambda_boundary"), none.cast("string").alias("ddt_status"), none.cast("string").alias("ddt_selection"),
        F.lit(False).alias("inductance_off"), (u % 31 == 0).alias("major_unresolved"), F.lit(False).alias("poles_incompatible"), F.lit(False).alias("major_noise_sensitive"), "evidence_status",
    )


_VERDICTS = _EVIDENCE + """, vd AS (SELECT uid, evidence_status, uid % 13 <> 0 AS done, concat_ws('|', CASE WHEN uid % 13 = 0 THEN 'computation-not-completed' END, CASE WHEN uid % 5 = 0 THEN 'KK-not-screen-pass' END,
  CASE WHEN uid % 17 = 0 THEN 'KK-subset-needs-full-point-confirmation' END, CASE WHEN uid % 19 = 0 THEN 'lambda-boundary-sensitive' END, CASE WHEN uid % 23 = 0 THEN 'primary-reconstruction-RMS-missing-or-nonfinite' WHEN uid % 7 = 0 THEN 'primary-reconstruction-RMS-above-2-percent-heuristic' END,
  CASE WHEN uid % 29 = 0 THEN 'signed_gdrt-required-not-completed' END, CASE WHEN uid % 29 = 0 THEN 'ordinary-RC-kernel-incompatible' END, CASE WHEN uid % 31 = 0 THEN 'major-peak-unresolved' END) AS reasons FROM es),
vn AS (SELECT *, CASE WHEN NOT done THEN 'failed' WHEN reasons <> '' THEN 'review-required' ELSE 'supported' END AS numeric_status FROM vd),
vv AS (SELECT *, CASE WHEN numeric_status <> 'supported' OR evidence_status = 'contradicted' THEN 'review-required' WHEN evidence_status = 'supported' THEN 'accepted-with-supplied-controls' ELSE 'controls-incomplete-no-acceptance' END AS validity_status FROM vn)"""


@query(f"""WITH {_VERDICTS} SELECT uid, numeric_status, validity_status, CASE WHEN validity_status = 'accepted-with-supplied-controls' THEN 'included' WHEN NOT done THEN 'review-pending' WHEN reasons <> '' OR evidence_status = 'contradicted' THEN 'diagnostic-only' ELSE 'included-exploratory' END AS display_role,
  CASE numeric_status WHEN 'supported' THEN 'numerically_supported_mechanism_unassigned' ELSE 'diagnostic_only' END AS claim_level, CASE reasons WHEN '' THEN 'numerical-screens-supported' ELSE reasons END AS decision_basis FROM vv""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.verdicts(_results(_evidence(spark, sf_dir)))
    return v.select("uid", "numeric_status", "validity_status", "display_role", "claim_level", F.array_join("decision_basis", "|").alias("decision_basis"))


@query(f"""WITH {_VERDICTS} SELECT CASE WHEN count(*) = 0 OR bool_or(validity_status = 'review-required') THEN 'review-required' ELSE 'other' END AS overall_verdict, count(*) FILTER (validity_status = 'review-required') AS n_review,
  count(*) FILTER (validity_status = 'accepted-with-supplied-controls') AS n_accepted, count(*) FILTER (validity_status = 'controls-incomplete-no-acceptance') AS n_incomplete FROM vv""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overall(C.verdicts(_results(_evidence(spark, sf_dir))))


_SHOWN = [1, 2, 3, 5]


@query(f"""WITH {B.SQL}, r AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY i) AS row, zreal, neg_zimag FROM p WHERE i >= uid % 3)
SELECT row::INT AS row, {", ".join(f"round(max(zreal) FILTER (uid = {k}), 6) + 0e0 AS x{k}, round(max(neg_zimag) FILTER (uid = {k}), 6) + 0e0 AS y{k}" for k in _SHOWN)} FROM r WHERE uid IN (1, 2, 3, 5) GROUP BY row""")
def origin_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir).where(F.col("uid").isin(_SHOWN) & (F.col("i") >= F.col("uid") % 3))
    w = T.wide_pairs(p, "uid", "i", "zreal", "neg_zimag", _SHOWN)
    return w.select("row", *[r6(f"{k}_{a}").alias(f"{a}{k}") for k in _SHOWN for a in ("x", "y")])


@query(f"""WITH {B.SQL} SELECT i, {", ".join(f"round(max(zreal) FILTER (uid = {k}), 6) + 0e0 AS z{k}" for k in _SHOWN)} FROM p WHERE uid IN (1, 2, 3, 5) GROUP BY i""")
def exact_grid_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir).where(F.col("uid").isin(_SHOWN))
    return T.exact_matrix(p, "uid", "i", "zreal", _SHOWN).select("i", *[r6(F.col(str(k))).alias(f"z{k}") for k in _SHOWN])


@query("""SELECT s_suppkey // 4 AS cell, count(*) AS members, CASE WHEN count(DISTINCT s_suppkey % 3 = 0) = 1 THEN 1 ELSE 2 END::BIGINT AS grids FROM supplier GROUP BY 1""")
def shared_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir).where((F.col("uid") % 3 != 0) | (F.col("i") > 0)).withColumn("cell", F.floor(F.col("uid") / 4))
    return T.shared_grid(p, "cell", "uid", "i")


@query(f"""WITH {B.SQL}, c AS (SELECT uid // 4 AS cell, uid, i FROM p WHERE i BETWEEN uid % 5 AND 60 - uid % 7),
x AS (SELECT cell, max(lo) AS lo, min(hi) AS hi FROM (SELECT cell, uid, min(i) AS lo, max(i) AS hi FROM c GROUP BY ALL) GROUP BY cell)
SELECT cell, uid, count(*) AS points, min(i) - 0.5e0 AS left_edge, max(i) + 0.5e0 AS right_edge FROM c JOIN x USING (cell) WHERE i BETWEEN lo AND hi GROUP BY ALL""")
def trend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir).where("i BETWEEN uid % 5 AND 60 - uid % 7").select(F.floor(F.col("uid") / 4).alias("cell"), "uid", F.col("i").cast("double").alias("x"))
    edges = T.cell_edges(T.common_window(p, "cell", "uid", "x"), "uid", "x")
    return edges.groupBy("cell", "uid").agg(F.count(F.lit(1)).alias("points"), F.min("left").alias("left_edge"), F.max("right").alias("right_edge"))


@query("""SELECT s_suppkey AS uid, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE -s_acctbal END, s_suppkey)::INT AS rank,
  ((row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE -s_acctbal END, s_suppkey) - 1) // 3 + 1)::BIGINT AS page FROM supplier""")
def trend_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), "s_nationkey", F.col("s_acctbal").alias("voltage_v"), F.when(F.col("s_nationkey") % 2 == 0, "charge").otherwise("Discharge").alias("direction"))
    return T.trend_order(s, "s_nationkey", 3).select("uid", "rank", "page")


@query("SELECT s_suppkey AS uid FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 2 = 0)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"))
    done = s.where("uid % 3 = 0").select("uid", F.lit("run-1").alias("fingerprint"), F.when(F.col("uid") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return T.pending(s, done.unionByName(s.where("uid % 5 = 0").select("uid", F.lit("run-0").alias("fingerprint"), F.lit("completed").alias("status"))), "run-1")


@query("""SELECT doc_id, regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace(source || ' ' || substr(text, 1, 30), '[^0-9A-Za-z._-]+', '_', 'g'), '_+', '_', 'g'), 1, 200), '^[_.]+', ''), '[_.]+$', '') AS slug,
  CASE WHEN regexp_matches(substr(text, 1, 5), '^\\s*[=+\\-@]') THEN chr(39) ELSE '' END || substr(text, 1, 5) AS cell FROM documents""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents")
    start = F.substring("text", 1, 5)
    return d.select("doc_id", S.slug(F.concat("source", F.lit(" "), F.substring("text", 1, 30))).alias("slug"), S.spreadsheet_safe(start).alias("cell"))


@query("""SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 11 = 0 THEN 'numerical-not-completed' WHEN s_suppkey % 7 = 0 THEN 'not-ordinary-RC-eligible' WHEN s_suppkey % 5 = 0 THEN 'diagnostic-or-unreviewed-display-role' WHEN s_suppkey % 13 = 0 THEN 'missing-cell-or-sample-identity'
  WHEN s_suppkey % 3 = 0 THEN 'missing-direction' WHEN s_suppkey % 17 = 0 THEN 'missing-finite-voltage' WHEN s_suppkey % 4 = 0 THEN 'unsupported-or-missing-impedance-basis' ELSE 'eligible-awaiting-group' END AS plot_reason FROM supplier""")
def trend_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("s_suppkey")
    r = B.read(spark, sf_dir, "supplier").select(
        u.alias("uid"), F.when(u % 11 != 0, "completed").alias("status"), (u % 7 != 0).alias("ordinary_rc_eligible"), F.when(u % 5 == 0, "diagnostic-only").otherwise("included").alias("display_role"),
        F.when(u % 13 != 0, "c1").alias("cell_id"), F.lit("").alias("sample_id"), F.when(u % 3 != 0, "charge").alias("direction"), F.when(u % 17 == 0, float("nan")).otherwise(3.7).alias("voltage_v"), F.when(u % 4 == 0, "S").otherwise("ohm").alias("basis"),
    )
    return T.trend_eligibility(r).select("uid", "plot_reason")


@query(f"""WITH {B.SQL}, s AS (SELECT uid, zreal * CASE WHEN uid % 2 = 0 THEN 0.001e0 ELSE 1 END AS v FROM p), m AS (SELECT uid, max(abs(v)) AS t, min(v) AS lo, max(v) AS hi FROM s GROUP BY uid)
SELECT uid, CASE WHEN t < 0.1 THEN 1000e0 ELSE 1e0 END AS unit_factor, round((lo - 0.06e0 * (hi - lo)) * CASE WHEN t < 0.1 THEN 1000 ELSE 1 END, 6) + 0e0 AS low, round((hi + 0.06e0 * (hi - lo)) * CASE WHEN t < 0.1 THEN 1000 ELSE 1 END, 6) + 0e0 AS high FROM m""")
def display_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.points(spark, sf_dir).withColumn("v", F.col("zreal") * F.when(F.col("uid") % 2 == 0, 0.001).otherwise(1.0))
    return T.display_limits(p, "uid", "v").select("uid", "unit_factor", r6("low").alias("low"), r6("high").alias("high"))


@query(f"""WITH {B.SQL} SELECT uid, i, round(sqrt(zreal * zreal + neg_zimag * neg_zimag), 6) + 0e0 AS modulus, CASE uid % 3 WHEN 0 THEN 'consistency-screen-pass' WHEN 1 THEN 'review-required' ELSE 'parsed-not-screened' END AS numeric_status FROM p""")
def eis_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kk = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.when(F.col("s_suppkey") % 3 == 0, "screen-pass").otherwise("warn").alias("kk_status")).where("uid % 3 <> 2")
    return T.quantities(B.points(spark, sf_dir), kk).select("uid", "i", r6("modulus").alias("modulus"), "numeric_status")
