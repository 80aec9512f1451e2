"""Text, containers, manifests, publishing and the stream."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from ohmtide.sinks import publish
from ohmtide.sources import files, irf
from ohmtide.sources.text import Layout, parse
from ohmtide.streaming.incremental import watch


def read(spark, tmp_path, name, text, layout=Layout(), encoding="utf-8"):
    (tmp_path / name).write_bytes(text.encode(encoding))
    found, ledger, points = parse(files.discover(spark, [str(tmp_path)]).where(F.col("path").endswith(name)), layout)
    return found.collect(), ledger.orderBy("source_line").collect(), points.orderBy("source_line").collect()


def test_semicolons_and_signs(spark, tmp_path):
    found, ledger, points = read(spark, tmp_path, "a.csv", "freq (Hz);Z_prime (ohm);Z_double_prime (ohm)\n1000;1;0.2\n10;2;-0.4\n1;3;-0.1\n")
    assert found[0].status == "parsed" and [round(p.neg_zimag, 9) for p in points] == [-0.2, 0.4, 0.1] and [p.acquisition_index for p in points] == [2, 3, 4]
    assert [r.status for r in ledger] == ["header", "included", "included", "included"]


def test_units_comma_and_quotes(spark, tmp_path):
    text = 'made by x\n"Frequency (kHz)",Zreal (mohm),-Z\'\' (mohm),Valid\n1,1000,100,1\n0.1,2000,200,1\n0.1,2000,200,0\nx,1,1,1\n-1,1,1,1\n,,,\n5\n1,1,1,no\n"a,1,1,1\n'
    found, ledger, points = read(spark, tmp_path, "b.csv", text)
    assert [(p.frequency_hz, p.zreal, round(p.neg_zimag, 9)) for p in points] == [(1000, 1, 0.1), (100, 2, 0.2)]
    assert [r.reason for r in ledger] == ["preamble", "header", "valid-eis-row", "valid-eis-row", "Valid=0", "nonnumeric_or_nonfinite", "nonpositive_frequency", "blank_row", "short_row", "invalid_valid_flag", "csv_parse_error"]


@pytest.mark.parametrize(
    ("text", "error"),
    [("Time (s),Voltage (V)\n1,2\n", "no-impedance-header"), ("Frequency,Z' (ohm),-Z'' (ohm)\n1,1,1\n", "ambiguous-frequency-unit"), ("Frequency (Hz),freq (Hz),Z' (ohm),-Z'' (ohm)\n1,1,1,1\n", "ambiguous-columns"),
     ("freq (Hz),Z' (ohm),-Z'' (ohm cm2)\n1,1,1\n", "incompatible-units"), ("freq (Hz),Z',-Z''\n1,1,1\n", "ambiguous-impedance-unit"), ("freq (Hz),Z' (ohm),-Z'' (ohm)\n0,1,1\n", "no-valid-points")],
)
def test_refusals_are_rows(spark, tmp_path, text, error):
    found, ledger, points = read(spark, tmp_path, "c.csv", text)
    assert found[0].status == "failed" and found[0].error == error and points == [] and len(ledger) == 2


def test_two_sweeps_whitespace_and_other_encodings(spark, tmp_path):
    text = "频率(Hz) Z'(ohm) -Z''(ohm)\n" + "".join(f"{f} 1 1\n" for f in (1000, 100, 10, 1000, 100, 10))
    for k, encoding in enumerate(("utf-8-sig", "gb18030")):
        _, _, points = read(spark, tmp_path, f"d{k}.txt", text, encoding=encoding)
        assert [p.spectrum_id.rsplit(":", 1)[1] for p in points] == ["run1"] * 3 + ["run2"] * 3


def test_declared_columns(spark, tmp_path):
    layout = Layout(delimiter="comma", headerless=True, columns={"frequency": 2, "zreal": 0, "zimag": 1}, frequency_unit="mhz", impedance_unit="kohm", imag_convention="zimag")
    _, _, points = read(spark, tmp_path, "e.csv", "1,-2,1000\n2,-3,500\n", layout)
    assert [(p.frequency_hz, p.zreal, p.neg_zimag) for p in points] == [(1, 1000, 2000), (0.5, 2000, 3000)]
    with pytest.raises(ValueError):
        Layout(headerless=True)


def container(rows) -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute('CREATE TABLE t ("Index" INTEGER, VerifiedAppliedFrequency REAL, ImpedanceReal REAL, ImpedanceImaginary REAL)')
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    con.commit()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.db", con.serialize())
    return out.getvalue()


def test_containers(spark, tmp_path):
    (tmp_path / "a.irf").write_bytes(container([(2, 100, 2, -0.2), (1, 1000, 1, -0.1), (3, 0, 1, 1)]))
    (tmp_path / "b.irf").write_bytes(b"no zip")
    rows = irf.read(files.discover(spark, [str(tmp_path)])).orderBy("path", "i").collect()
    assert [(r.frequency_hz, r.neg_zimag, r.reason) for r in rows[:3]] == [(1000, 0.1, None), (100, 0.2, None), (0, -1, "nonpositive_frequency")]
    assert "BadZipFile" in rows[3].error


def test_manifest_and_inventory(spark, tmp_path):
    for n, text in (("a.csv", "freq (Hz),Z' (ohm),-Z'' (ohm)\n"), ("b.csv", "tau_s,gamma\n"), ("c.csv", "x\n")):
        (tmp_path / n).write_text(text)
    found = files.discover(spark, [str(tmp_path)]).where(F.col("suffix") == ".csv")
    plain = {r.path.rsplit("/", 1)[1]: r.selected for r in files.inventory(found).collect()}
    assert plain == {"a.csv": True, "b.csv": False, "c.csv": True}
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in found.select("path").collect()}
    m = tmp_path / "m" / "manifest.csv"
    m.parent.mkdir()
    m.write_text(f"path,spectrum_id,include\n{paths['a.csv']},,yes\n{paths['b.csv']},,no\n/missing,,\n")
    own = {r.path.rsplit("/", 1)[1]: (r.selected, r.selection_reason) for r in files.inventory(found, files.read_manifest(spark, str(m))).collect()}
    assert own == {"a.csv": (True, "manifest"), "b.csv": (False, "excluded-by-manifest"), "c.csv": (False, "not-in-manifest"), "missing": (False, "requested-but-missing")}
    m.write_text("path,spectrum_id\na,1\na,1\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(m))


def test_publishing_once(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "=1+1", [1])], "a int, b double, c string, d array<int>")
    row = publish.flat(df).first()
    assert row.b is None and row.c == "'=1+1" and row.d == "[1]"
    first = publish.publish(spark, {"t": df}, str(tmp_path), "run1").collect()
    again = publish.publish(spark, {"t": df.union(df)}, str(tmp_path), "run1").collect()
    assert first == again and first[0].rows == 1
    assert not any(p.name.startswith(("_staging", "_lock")) for p in tmp_path.iterdir())
    inputs = spark.createDataFrame([("u", "h")], "source_uid string, source_sha256 string")
    assert publish.fingerprint({"a": 1}, inputs) != publish.fingerprint({"a": 2}, inputs)


def test_publishing_is_whole_or_not_at_all(spark, tmp_path):
    df, folder = spark.range(5), str(tmp_path)
    assert publish.current(spark, folder) is None
    publish.publish(spark, {"t": df}, folder, "run-b")
    with pytest.raises(Exception, match="(?i)zero"):
        publish.publish(spark, {"t": df, "u": df.select(F.expr("id / (id - id)").alias("x"))}, folder, "run-a")
    assert {p.name for p in tmp_path.iterdir()} == {"run-b", "_history-analysis"} and publish.current(spark, folder) == "run-b"
    publish.publish(spark, {"t": df.union(df)}, folder, "run-a")
    assert publish.current(spark, folder) == "run-a" and publish.published(spark, folder, "run-b")
    (tmp_path / "run-c").mkdir()
    with pytest.raises(FileExistsError):
        publish.publish(spark, {"t": df}, folder, "run-c")
    (tmp_path / "_lock-analysis").touch()
    with pytest.raises(RuntimeError, match="in progress"):
        publish.publish(spark, {"t": df}, folder, "run-d")
    assert (tmp_path / "_lock-analysis").exists()
    for name in ("../x", "a/b", "_manifest", ""):
        with pytest.raises(ValueError):
            publish.publish(spark, {name: df}, folder, "run-e")


def test_changed_tables_are_told(spark, tmp_path):
    publish.publish(spark, {"t": spark.range(5), "u": spark.sql("SELECT map('a', 1) AS m, cast(null AS int) AS n")}, str(tmp_path), "r")
    assert publish.changed(spark, str(tmp_path), "r") == []
    spark.range(6).withColumn("run_fingerprint", F.lit("r")).write.mode("overwrite").parquet(str(tmp_path / "r" / "t"))
    assert publish.changed(spark, str(tmp_path), "r") == ["t"]


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "a.doc").write_text("x")
    with pytest.raises(ValueError, match="no supported files"):
        files.discover(spark, [str(tmp_path)])


def test_one_time_has_no_steps(spark):
    from ohmtide.operators.sequence import time_summary

    rows = spark.createDataFrame([("a", 0, 5.0), ("a", 1, None), ("b", 0, None)], "k string, i int, t double")
    (one,) = time_summary(rows, "k", "i", "t").collect()
    assert (one.k, one.start, one.end, one.duration, one.median_step, one.anomalies, one.first_anomalies) == ("a", 5.0, 5.0, 0.0, None, 0, None)


def test_containers_without_databases_or_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.irf", "w") as z:
        z.writestr("a.json", '[[{"State": 3}], {"State": "x", "FrequencyDistribution": [null, "y"]}, {"FrequencyDistribution": [2, [1]]}]')
    found = files.discover(spark, [str(tmp_path)])
    assert [r.error for r in irf.read(found).collect()] == ["no-impedance-table"] and irf.events(found).count() == 0
    (one,) = irf.procedures(found).collect()
    assert (one.state, one.programmed, one.header_parameters, one.error) == ("3", [2.0, 1.0], "[]", None)
    assert irf.schedules(irf.read(found), irf.procedures(found)).count() == 0 and irf.spectra(irf.read(found)).count() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = "freq (Hz),Z' (ohm),-Z'' (ohm)\n10,1,1\n1,2,1\n"
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_text(table)
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out" / "points")).count() == 2 * (k + 1)


def test_alignment_is_the_same_by_order_and_point_by_point(spark):
    import random

    from pyspark.sql import functions as F

    from ohmtide.operators import controls

    rng = random.Random(1)

    def grid():
        found = [(float(10 ** (rng.choice([0, 0.5, 1, 1.5, 2, 3]) + rng.choice([0, 0, 4e-6, 9e-6, 1.2e-5, -6e-6]))), rng.random(), rng.random()) for _ in range(rng.randrange(9))]
        return found if rng.random() < 0.4 else list({round(x[0]): x for x in found}.values())

    rows = spark.createDataFrame([(grid(), grid()) for _ in range(400)], f"a array<{controls.POINT}>, b array<{controls.POINT}>")
    a, b = F.col("a"), F.col("b")
    both = controls._spread(a, controls.TOLERANCE) & controls._spread(b, controls.TOLERANCE)
    found = rows.select(controls.align(a, b).alias("found"), controls._greedy(a, b, controls.TOLERANCE).alias("plain"), both.alias("ordered")).collect()
    assert all(r.found == r.plain for r in found)
    assert 50 < sum(r.ordered for r in found) < 350 and any(r.ordered and r.plain for r in found)
