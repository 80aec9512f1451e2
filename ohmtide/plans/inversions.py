"""Queries of the inversions. Their SQL says what the spectra's closed forms make known: the truth that a solution must recover."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmtide.invert import branches as X
from ohmtide.invert import consistency as K
from ohmtide.invert import drt as D
from ohmtide.numerics.curves import match
from ohmtide.operators.invert import per_spectrum
from ohmtide.plans import bridge as B

QUERIES, SQL = {}, {}
LAMBDA = 1e-4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.spectra(B.points(spark, sf_dir))


def _truth(k: int) -> dict[str, float]:
    return {"r0": 0.8 + 0.1 * (k % 4), "r1": 1 + k % 5, "t1": 2e-4 * (1 + k % 3), "r2": 3 + 0.5 * (k % 7), "t2": 0.02 * (1 + k % 4), "l": 1e-6 * (k % 3)}


def _nearest(value: float, grid: list[float]) -> float:
    """The value of a logarithmic grid that a recovered one is nearest to: solutions are regularised, and compared at the grid's step."""
    return min(grid, key=lambda g: abs(math.log(value / g)))


TAU_1, TAU_2 = [2e-4 * i for i in range(1, 7)], [0.02 * i for i in range(1, 7)]
PROCESSES = "tau_1 double, ohm_1 double, tau_2 double, ohm_2 double"
#: The two processes that each spectrum is made of.
TRUE_PROCESSES = "round(2e-4 * (1 + s_suppkey % 3), 6) AS tau_1, (1 + s_suppkey % 5)::DOUBLE AS ohm_1, round(0.02e0 * (1 + s_suppkey % 4), 6) AS tau_2, 3 + 0.5e0 * (s_suppkey % 7) AS ohm_2"


def _processes(k: int, peaks: list[dict], least: float = 0.02) -> dict:
    """Times (at the grid's step) and areas (in halves of an ohm, the first in whole ones) of the peaks that stand for the two
    processes; null where there is none within 0.35 decades."""
    t, big = _truth(k), [q for q in peaks if q.get("relative_height", 1.0) >= least]
    pairs = match([t["t1"], t["t2"]], [q["tau_s"] for q in big], 0.35)[0] if big else {}
    of = lambda i: big[pairs[i][0]] if i in pairs else None
    one, two = of(0), of(1)
    area = lambda q, steps: None if q is None or q.get("area_impedance") is None else round(steps * q["area_impedance"]) / steps
    return {"tau_1": one and round(_nearest(one["tau_s"], TAU_1), 6), "ohm_1": area(one, 1), "tau_2": two and round(_nearest(two["tau_s"], TAU_2), 6), "ohm_2": area(two, 2)}


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).withColumn("k", F.col("uid"))


@query(f"SELECT s_suppkey AS uid, {TRUE_PROCESSES}, round(0.8e0 + 0.1e0 * (s_suppkey % 4), 1) AS r_inf, 'completed' AS status FROM supplier")
def drt_primary_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(f, z, k):
        p = D.Problem(f, z)
        return [_processes(k, p.peaks(LAMBDA)) | {"r_inf": round(p.solve(LAMBDA)["r_inf"], 1)}]

    return per_spectrum(_keyed(spark, sf_dir), solve, f"{PROCESSES}, r_inf double", "k").select("uid", "tau_1", "ohm_1", "tau_2", "ohm_2", "r_inf", "status")


@query("SELECT s_suppkey AS uid, round(0.8e0 + 0.1e0 * (s_suppkey % 4) + 1 + s_suppkey % 5 + 3 + 0.5e0 * (s_suppkey % 7), 1) AS total_ohm FROM supplier")
def drt_total_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(f, z):
        s = D.Problem(f, z).solve(LAMBDA)
        return [{"total_ohm": round(s["r_inf"] + float(np.trapezoid(s["gamma"], np.log(s["tau_s"]))), 1)}]

    return per_spectrum(_spectra(spark, sf_dir), solve, "total_ohm double").select("uid", "total_ohm")


@query("SELECT s_suppkey AS uid, (s_suppkey % 3)::DOUBLE AS inductance_uh FROM supplier")
def drt_series_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series inductance, to a tenth of a microhenry."""
    solve = lambda f, z: [{"inductance_uh": round(D.Problem(f, z).solve(LAMBDA)["inductance_h"] * 1e6, 1)}]
    return per_spectrum(_spectra(spark, sf_dir), solve, "inductance_uh double").select("uid", "inductance_uh")


@query("SELECT s_suppkey AS uid, c AS factor, 1e0 AS top_ratio, round(0.8e0 + 0.1e0 * (s_suppkey % 4) + 1 + s_suppkey % 5 + 3 + 0.5e0 * (s_suppkey % 7), 1) AS total_ohm FROM supplier, (VALUES (-4), (4)) v(c)")
def scaling_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of spectra multiplied by 1e-4 and 1e4: the distribution's height against that of the spectrum as it is, and the total resistance
    divided again."""
    def solve(f, z):
        base, out = D.Problem(f, z).solve(LAMBDA), []
        for power in (-4, 4):
            s = D.Problem(f, z * 10.0**power).solve(LAMBDA)
            total = (s["r_inf"] + float(np.trapezoid(s["gamma"], np.log(s["tau_s"])))) / 10.0**power
            out.append({"factor": power, "top_ratio": round(float(s["gamma"].max() / base["gamma"].max()) / 10.0**power, 4), "total_ohm": round(total, 1)})
        return out

    return per_spectrum(_spectra(spark, sf_dir), solve, "factor int, top_ratio double, total_ohm double").select("uid", "factor", "top_ratio", "total_ohm")


@query(f"SELECT s_suppkey AS uid, {TRUE_PROCESSES}, true AS in_range FROM supplier")
def lambda_lcurve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recovered under the lambda that is chosen."""
    def solve(f, z, k):
        p = D.Problem(f, z)
        lam = D.select_lambda(p)["lambda"]
        return [_processes(k, p.peaks(lam)) | {"in_range": 1e-7 <= lam <= 1e-1}]

    return per_spectrum(_keyed(spark, sf_dir), solve, f"{PROCESSES}, in_range boolean", "k").select("uid", "tau_1", "ohm_1", "tau_2", "ohm_2", "in_range")


@query(f"SELECT s_suppkey AS uid, c AS factor, {TRUE_PROCESSES} FROM supplier, (VALUES (-1), (0), (1)) v(c)")
def lambda_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(f, z, k):
        return [{"factor": round(math.log10(c["lambda"] / LAMBDA))} | _processes(k, c["peaks"]) for c in D.sensitivity(D.Problem(f, z), LAMBDA)]

    return per_spectrum(_keyed(spark, sf_dir), solve, f"factor int, {PROCESSES}", "k").select("uid", "factor", "tau_1", "ohm_1", "tau_2", "ohm_2")


@query(f"SELECT uid, {PROCESSES.replace(' double', '')}, 'robust-to-lambda' AS confidence_1, 'robust-to-lambda' AS confidence_2, 3 AS persistence FROM (SELECT s_suppkey AS uid, {TRUE_PROCESSES} FROM supplier)")
def peak_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both processes stand at lambda, a tenth and ten times it, at one place and with one area."""
    def solve(f, z, k):
        p = D.Problem(f, z)
        rows = [q | {"relative_height": q["relative_height"] or 0.0} for q in D.classify(p, p.peaks(LAMBDA), D.sensitivity(p, LAMBDA))]
        t, big = _truth(k), [q for q in rows if q["relative_height"] >= 0.02]
        pairs = match([t["t1"], t["t2"]], [q["tau_s"] for q in big], 0.35)[0]
        own = [big[pairs[i][0]] for i in (0, 1)]
        return [_processes(k, rows) | {"confidence_1": own[0]["confidence"], "confidence_2": own[1]["confidence"], "persistence": min(q["persistence"] for q in own)}]

    return per_spectrum(_keyed(spark, sf_dir), solve, f"{PROCESSES}, confidence_1 string, confidence_2 string, persistence int", "k").drop("k", "status", "error")


@query("SELECT s_suppkey AS uid, true AS ordered, 1 + s_suppkey % 5 + 3 + 0.5e0 * (s_suppkey % 7) AS middle_ohm, true AS holds_truth FROM supplier")
def credible_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas under the band's two ends: their middle, to half an ohm, and whether the true one lies between."""
    def solve(f, z, k):
        p, t = D.Problem(f, z), _truth(k)
        a, b = D.credible_band(p, LAMBDA)
        low, high = (float(np.trapezoid(c, p.grid)) for c in (a, b))
        return [{"ordered": bool((a <= b + 1e-6 * b.max()).all()), "middle_ohm": round(low + high) / 2, "holds_truth": low <= t["r1"] + t["r2"] <= high}]

    return per_spectrum(_keyed(spark, sf_dir), solve, "ordered boolean, middle_ohm double, holds_truth boolean", "k").select("uid", "ordered", "middle_ohm", "holds_truth")


@query("SELECT s_suppkey AS uid, round(2e-4 * (1 + s_suppkey % 3), 6) AS tau_1, round(0.02e0 * (1 + s_suppkey % 4), 6) AS tau_2, 2::BIGINT AS paired_with_primary FROM supplier")
def nnls_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(f, z, k):
        p = D.Problem(f, z)
        second = [q for q in D.secondary(f, z)["peaks"] if q["relative_height"] >= 0.02]
        main = [q for q in p.peaks(LAMBDA) if q["relative_height"] >= 0.02]
        return [_processes(k, second) | {"paired_with_primary": sum(r["matched"] for r in D.compare_peaks(main, second))}]

    return per_spectrum(_keyed(spark, sf_dir), solve, f"{PROCESSES}, paired_with_primary bigint", "k").select("uid", "tau_1", "tau_2", "paired_with_primary")


#: What each point is moved by, up and down in turn, in percent: no consistent response does so, and the fit leaves it.
MOVED = (0.0, 0.7, 2.0, 5.0)


@query("""SELECT s_suppkey AS uid, [0, 1, 2, 5][s_suppkey % 4 + 1]::BIGINT AS rms_percent, ['screen-pass', 'warn', 'suspect', 'suspect'][s_suppkey % 4 + 1] AS status_drt,
  ['screen-pass', 'screen-pass', 'warn', 'suspect'][s_suppkey % 4 + 1] AS status_eis, [0, 1, 2, 5][s_suppkey % 4 + 1]::BIGINT AS rms_admittance FROM supplier""")
def kk_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(f, z, k):
        z = z * (1 + MOVED[k % 4] / 100 * np.where(np.arange(len(f)) % 2 == 0, 1, -1))
        rms = K.linear_kk(f, z)["rms_percent"]
        return [{"rms_percent": round(rms), "status_drt": K.kk_status(rms, "drt"), "status_eis": K.kk_status(rms, "eis"), "rms_admittance": round(K.linear_kk(f, z, admittance=True)["rms_percent"])}]

    schema = "rms_percent bigint, status_drt string, status_eis string, rms_admittance bigint"
    return per_spectrum(_keyed(spark, sf_dir), solve, schema, "k").select("uid", "rms_percent", "status_drt", "status_eis", "rms_admittance")


@query("SELECT s_suppkey AS uid, 1::BIGINT AS clean_percent, 15::BIGINT AS drifted_percent FROM supplier")
def zhit_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modulus follows from the phase, and no longer does when it drifts by half: by 14.4 % in the root mean square of a drift from
    0.75 to 1.25, and what the relation itself is off."""
    def solve(f, z):
        drifted = z * np.linspace(0.75, 1.25, len(f))
        return [{"clean_percent": round(K.z_hit(f, z)["rms_percent"]), "drifted_percent": round(K.z_hit(f, drifted)["rms_percent"])}]

    return per_spectrum(_spectra(spark, sf_dir), solve, "clean_percent bigint, drifted_percent bigint").select("uid", "clean_percent", "drifted_percent")


def _closed(spark: SparkSession, sf_dir: str, solve, schema: str) -> DataFrame:
    """per_spectrum() for spectra that solve(k) makes itself."""
    keys = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_suppkey").alias("k"))
    empty = F.array().cast("array<struct<frequency_hz:double,zreal:double,neg_zimag:double>>")
    return per_spectrum(keys.withColumn("points", empty), lambda f, z, k: solve(k), schema, "k")


@query("""SELECT s_suppkey AS uid, 0.02e0 AS tau_s, CASE WHEN s_suppkey % 2 = 1 THEN 0.5e0 END AS negative_tau_s, CASE WHEN s_suppkey % 2 = 1 THEN 1.5e0 ELSE 3e0 END AS net_ohm,
  CASE WHEN s_suppkey % 2 = 1 THEN 2.3e0 ELSE 0.8e0 END AS r_inf FROM supplier""")
def signed_gdrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RL process of 1.5 ohm in every second spectrum: it is in the offset, and a negative lobe at its time takes it off again."""
    def solve(k):
        f = np.logspace(5, -3, 61)
        s = 2j * np.pi * f
        r = X.signed_distribution(f, 0.8 + 3 / (1 + 0.02 * s) + (k % 2) * 1.5 * 0.5 * s / (1 + 0.5 * s))
        tau, g = r["tau_s"], r["gamma"]
        return [{"tau_s": _nearest(tau[np.argmax(g)], [0.01, 0.02, 0.04]), "negative_tau_s": round(float(tau[np.argmin(g)]), 1) if k % 2 else None, "net_ohm": round(float(np.trapezoid(g, np.log(tau))), 1), "r_inf": round(r["r_inf"], 1)}]

    return _closed(spark, sf_dir, solve, "tau_s double, negative_tau_s double, net_ohm double, r_inf double").select("uid", "tau_s", "negative_tau_s", "net_ohm", "r_inf")


@query("""SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 2 = 0 THEN 'positive_rc' ELSE 'signed_rc' END AS selected, true AS reliable,
  CASE WHEN s_suppkey % 2 = 0 THEN 'predictive_positive_rc' ELSE 'predictive_signed_rc' END AS recommended, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 25 END::BIGINT AS r_inf,
  (20 + s_suppkey % 11 - 20 * (s_suppkey % 2))::BIGINT AS net_ohm FROM supplier""")
def predictive_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sign predicts left-out points, what it recovers, and the branch that is recommended beside the primary solution's own error."""
    def solve(k):
        f = np.geomspace(1e4, 0.01, 61)
        s = 2j * np.pi * f
        z = 5 + (20 + k % 11) / (1 + 0.03 * s) + (k % 2) * 20 * 0.003 * s / (1 + 0.003 * s)
        r = X.prediction(f, z)
        c, primary = r["candidates"][r["selected"]], D.Problem(f, z).solve(LAMBDA)["rms_percent"]
        net = float(np.trapezoid(c["gamma"], np.log(c["tau_s"])))
        return [{"selected": r["selected"], "reliable": c["reliable"], "recommended": X.recommend(primary, None, bool(k % 2), r)[0], "r_inf": round(c["r_inf"]), "net_ohm": round(net)}]

    return _closed(spark, sf_dir, solve, "selected string, reliable boolean, recommended string, r_inf bigint, net_ohm bigint").drop("k", "status", "error")


@query("""SELECT s_suppkey AS uid, ['transmissive-short', 'blocking-open', 'gerischer'][s_suppkey % 3 + 1] AS boundary, [0.1e0, 0.2e0, 0.5e0][s_suppkey // 3 % 3 + 1] AS tau_s, 3::BIGINT AS ohm, true AS accepted FROM supplier""")
def ddt_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and resistance of finite diffusion under its own boundary, which the rules accept."""
    def solve(k):
        f, name, t = np.logspace(5, -3, 61), X.BOUNDARIES[1:][k % 3], (0.1, 0.2, 0.5)[k // 3 % 3]
        r = X.diffusion(f, 0.8 + 3 * X.diffusion_kernel(name)(2 * np.pi * f, np.array([t]))[:, 0])
        c = r["candidates"][name]
        return [{"boundary": name, "tau_s": _nearest(c["peak_tau_s"], [0.05, 0.1, 0.2, 0.5, 1.0]), "ohm": round(float(np.trapezoid(c["gamma"], np.log(c["tau_s"])))), "accepted": name in r["accepted"]}]

    return _closed(spark, sf_dir, solve, "boundary string, tau_s double, ohm bigint, accepted boolean").select("uid", "boundary", "tau_s", "ohm", "accepted")


@query("SELECT s_suppkey AS uid, round(1 + 0.25e0 * (s_suppkey % 9), 6) AS sigma FROM supplier")
def warburg_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(k):
        f = np.logspace(5, -3, 61)
        s = 2j * np.pi * f
        return [{"sigma": round(X.warburg(f, 0.8 + 2e-6 * s + (1 + 0.25 * (k % 9)) / np.sqrt(s))["sigma"], 6)}]

    return _closed(spark, sf_dir, solve, "sigma double").select("uid", "sigma")


@query("SELECT s_suppkey AS uid, round(0.01e0 * (1 + s_suppkey % 5), 6) AS tau_s, round(10e0 + s_suppkey % 13, 6) AS weight_ohm FROM supplier")
def loewner_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(k):
        f = np.logspace(4, -2, 50)
        s = 2j * np.pi * f
        r = X.loewner(f, 2 + (10 + k % 13) / (1 + 0.01 * (1 + k % 5) * s))
        return [{"tau_s": round(t, 6), "weight_ohm": round(w, 6)} for t, w, _ in X.rc_rl_weights(r["model"]) if w > 1e-3]

    return _closed(spark, sf_dir, solve, "tau_s double, weight_ohm double").select("uid", "tau_s", "weight_ohm")


@query("""SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 2 = 0 THEN round(100e0 / (1 + s_suppkey % 5), 3) ELSE 100e0 END AS pole, CASE WHEN s_suppkey % 2 = 0 THEN round(100e0 / (1 + s_suppkey % 5), 3) ELSE 1.5e0 END AS damping,
  CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 END::BIGINT AS oscillating, 0e0 AS heldout_percent FROM supplier""")
def loewner_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pole of an RC process, or of a resonance, from a model that predicts left-out points to a thousandth of a percent."""
    def solve(k):
        f = np.logspace(3, -2, 70)
        s = 2j * np.pi * f
        z = 2 + 30 / (1 + 0.01 * (1 + k % 5) * s) if k % 2 == 0 else 2 + 300 * s / (s * s + 3 * s + 1e4)
        r = X.loewner(f, z)
        m = r["model"]
        pole = m["poles"][np.argmax(np.abs(m["residues"]))]
        return [{"pole": round(abs(complex(pole)), 3), "damping": round(-float(pole.real), 3), "oscillating": r["audit"]["oscillating"], "heldout_percent": round(r["heldout_percent"], 3)}]

    return _closed(spark, sf_dir, solve, "pole double, damping double, oscillating bigint, heldout_percent double").select("uid", "pole", "damping", "oscillating", "heldout_percent")


@query("SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 2 = 0 THEN 'series-L' END AS selected, CASE WHEN s_suppkey % 2 = 0 THEN 1e0 + s_suppkey % 3 END AS inductance_uh FROM supplier")
def model_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element that is taken out, and its amplitude."""
    def solve(k):
        f = np.logspace(5, -3, 61)
        s = 2j * np.pi * f
        on = k % 2 == 0
        r = X.reduce_model(f, 0.8 + 3 / (1 + 0.02 * s) + on * (1 + k % 3) * 1e-6 * s, 1e-4, {"series_l": on})
        return [{"selected": r["selected"], "inductance_uh": round(r["models"][r["selected"]]["amplitude"] * 1e6, 2) if r["selected"] else None}]

    return _closed(spark, sf_dir, solve, "selected string, inductance_uh double").select("uid", "selected", "inductance_uh")


@query("SELECT s_suppkey AS uid, round(2e-4 * (1 + s_suppkey % 3), 6) AS tau_1, round(0.02e0 * (1 + s_suppkey % 4), 6) AS tau_2 FROM supplier")
def peak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of noisy spectra, both true processes persist, at their times, under changed residuals and left-out points."""
    def solve(f, z, k):
        noise = np.random.default_rng(int(k))
        z = z * (1 + 0.002 * (noise.standard_normal(len(f)) + 1j * noise.standard_normal(len(f))))
        return [_processes(k, [r for r in X.perturbation_evidence(f, z, 1e-3) if r["sign_share"] >= 0.8 and r["deletion_share"] >= 0.75])]

    return per_spectrum(_keyed(spark, sf_dir), solve, PROCESSES, "k").select("uid", "tau_1", "tau_2")


@query("""SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN 2 WHEN c_custkey % 3 = 1 THEN 3 ELSE 1 END::BIGINT AS matched, c_custkey % 3 = 2 AS resolution_changed,
  round(CASE c_custkey % 3 WHEN 0 THEN log10(1.2e0) + log10(1.5e0) WHEN 1 THEN -log10(0.9e0) + log10(1.1e0) ELSE -log10(0.8e0) END, 6) AS decades FROM customer""")
def peak_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that move a little, stay, or split in two, with the sum of their distances."""
    def solve(f, z, k):
        left = [1e-4, 1e-2, 1.0]
        right = [[1.2e-4, 1.5e-2, 30.0], [1e-4, 0.9e-2, 1.1], [0.8e-4, 1.25e-4]][k % 3]
        pairs, change = match(left, right, 0.3)
        return [{"matched": len(pairs), "resolution_changed": any(change), "decades": round(sum(d for _, d in pairs.values()), 6)}]

    keys = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_custkey").alias("k"))
    empty = F.array().cast("array<struct<frequency_hz:double,zreal:double,neg_zimag:double>>")
    return per_spectrum(keys.withColumn("points", empty), solve, "matched bigint, resolution_changed boolean, decades double", "k").select("uid", "matched", "resolution_changed", "decades")


@query("SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM supplier")
def failures_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated frequencies refuse an inversion, which is a row of its own."""
    s = _spectra(spark, sf_dir).withColumn("points", F.when(F.col("uid") % 5 == 0, F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points")))
    return per_spectrum(s, lambda f, z: [{"rms_percent": D.Problem(f, z).solve(LAMBDA)["rms_percent"]}], "rms_percent double").select("uid", "status")
