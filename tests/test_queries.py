"""Every query with SQL against DuckDB on the smallest tables, and the analysis of a batch."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ohmtide.plans import analysis, bridge, catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(rows):
    def one(x):
        return None if x is None else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(([one(x) for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_analysis(spark):
    points = bridge.points(spark, SF).where("uid <= 6")
    tables = analysis.run(points, bridge.spectra(points))
    results = tables["results"].toPandas()
    assert (results.status == "completed").all() and (results.kk_status == "screen-pass").all() and (results.recommended == "primary_drt").all()
    peaks = tables["peaks"].where(F.col("relative_height") > 0.1).groupBy("uid").count().toPandas()
    assert (peaks["count"] == 2).all()
    results = {r.uid: r for r in tables["results"].collect()}
    curve = tables["curves"].where("branch = 'primary_drt'")
    assert curve.where("NOT (low <= gamma + 1e-9 AND gamma <= high + 1e-9)").count() < 0.05 * curve.count()
    assert tables["sensitivity"].where("selected").select("uid").distinct().count() == 7 and tables["secondary"].where("matched").groupBy("uid").count().where("count >= 2").count() == 7
    assert {r.uid for r in tables["reductions"].select("uid").distinct().collect()} == {r.uid for r in results.values() if r.explainable or r.diffusive}
    back = tables["reduced_points"].join(points.select("uid", "frequency_hz", "zreal"), ["uid", "frequency_hz"])
    assert back.count() == tables["reduced_points"].count() and back.where("abs(addback_zreal - zreal) > 0.1 * zreal").count() == 0
    assert tables["reconstructions"].count() == points.count() and (tables["drift"].toPandas().status == "no-strong-monotonic-drift").all()


def test_profiles():
    import json

    whole = {"name": "a", "lambda_policy": "fixed", "fixed_lambda": 1e-3, "derivative_order": 2, "rbf_type": "Gaussian", "rbf_shape": "FWHM", "shape_coeff": 0.5, "inductance_policy": "off"}
    found = analysis.profile(json.dumps(whole | {"scope": "any"}))
    assert (found.lambda_policy, found.derivative_order, found.inductance_policy) == ("fixed", 2, "off")
    for bad in ({"extra": 1}, {"name": " "}, {"fixed_lambda": 0}, {"derivative_order": 3}, {"derivative_order": True}, {"rbf_type": "C2"}, {"lambda_policy": "x"}, {"shape_coeff": float("inf")}):
        with pytest.raises(ValueError):
            analysis.profile(json.dumps(whole | bad))
    with pytest.raises(ValueError):
        analysis.profile(json.dumps({k: v for k, v in whole.items() if k != "name"}))


def test_options_reach_the_inversions():
    import numpy as np

    f = np.logspace(5, -2, 41)
    z = 1 + 2 / (1 + 2j * np.pi * f * 2e-4) + 3 / (1 + 2j * np.pi * f * 0.02)
    options = analysis.Options("fixed", 1e-2, 2, 0.5, "off")
    (r,) = analysis.analyze(f, z, True, True, False, options)
    assert r["lambda"] == 1e-2 and r["inductance_h"] == 0 and {c["branch"] for c in r["curves"]} >= {"primary_drt", "secondary_nnls", "signed_gdrt", "predictive_positive_rc"}
    assert [s["lambda"] for s in r["scores"] if s["branch"] == "predictive_positive_rc" and s["selected"]]


def test_demo_bundle_and_report(spark):
    from ohmtide.plans.demo import demo
    from ohmtide.sinks import bundle

    points = demo(spark, 2)
    assert points.count() == 4 * 61 and points.select("voltage_v").distinct().count() == 2
    tables = {k: t.cache() for k, t in analysis.run(points.select("uid", "i", "frequency_hz", "zreal", "neg_zimag"), bridge.spectra(points)).items() if k in ("results", "peaks")}
    identity = points.select("uid", F.concat("direction", F.lit("-"), F.col("voltage_v").cast("string")).alias("label"), F.lit("ohm").alias("basis")).distinct()
    out = bundle.bundle(tables, identity)
    assert set(out["peaks"].columns) >= {"label", "basis", "confidence"} and out["results"].where("label IS NULL").count() == 0
    with pytest.raises(ValueError):
        bundle.bundle(tables, identity.union(identity))
    text = bundle.report(tables["results"], tables["peaks"])
    assert "- completed: 4" in text and "| 0 | P1 |" in text
