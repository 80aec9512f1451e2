"""The whole analysis of a batch: every branch of each spectrum in one call, then the tables of a run."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmtide.invert import branches as X
from ohmtide.invert import consistency as K
from ohmtide.invert import drt as D
from ohmtide.operators import screens as R
from ohmtide.operators.invert import per_spectrum
from ohmtide.operators.scratch import written

# --- fixed values: names of policies and of a profile's fields --------------------------------------------------------------
LAMBDA_POLICIES = ("fixed", "consensus", "lcurve-grid", "package-mgcv")
INDUCTANCE_POLICIES = ("adaptive", "always", "off")
PROFILE = ("name", "scope", "lambda_policy", "fixed_lambda", "derivative_order", "rbf_type", "rbf_shape", "shape_coeff", "inductance_policy")
# ---------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    """What a run decides for all its spectra."""

    lambda_policy: str = "consensus"
    fixed_lambda: float = 1e-3
    derivative_order: int = 1
    shape_coeff: float = 0.5
    inductance_policy: str = "adaptive"
    name: str = "none"

    def __post_init__(self):
        if self.lambda_policy not in LAMBDA_POLICIES or self.inductance_policy not in INDUCTANCE_POLICIES:
            raise ValueError("unknown policy")
        if isinstance(self.derivative_order, bool) or self.derivative_order not in (1, 2):
            raise ValueError("the derivative's order is 1 or 2")
        for x in (self.fixed_lambda, self.shape_coeff):
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x <= 0:
                raise ValueError("lambda and the shape's coefficient are positive numbers")
        if not isinstance(self.name, str) or not self.name.strip():
            raise ValueError("a profile has a name")


def profile(text: str) -> Options:
    """Options from a profile's JSON, which names every numerical option and nothing else; only Gauss functions by their width are known."""
    found = json.loads(text)
    if not isinstance(found, dict) or set(found) - set(PROFILE) or set(PROFILE) - {"scope"} - set(found):
        raise ValueError(f"a profile has the fields {PROFILE}, of which `scope` may be left out")
    if (str(found["rbf_type"]).lower(), str(found["rbf_shape"]).lower()) != ("gaussian", "fwhm"):
        raise ValueError("only Gauss functions by full width at half maximum are known")
    return Options(**{f.name: found[f.name] for f in fields(Options)})


PEAK = "struct<peak_id:string,tau_s:double,frequency_hz:double,gamma:double,relative_height:double,area_impedance:double,persistence:int,confidence:string>"
#: One row's results; arrays become the tables of their name.
RESULT = ", ".join([
    "lambda double, lambda_method string, lambda_boundary boolean, inductance_h double, r_inf double, rms_re_percent double, rms_im_percent double, kk_status string, kk_rms_percent double, zhit_rms_percent double",
    "signed_status string, signed_sensitivity string, signed_rms_percent double, ddt_status string, ddt_selection string, ddt_best string, loewner_order int, loewner_heldout_percent double, loewner_refit_percent double",
    "poles_material int, poles_oscillating int, poles_unstable int, poles_incompatible boolean, reduced string, recommended string, reasons array<string>",
    f"peaks array<{PEAK}>",
    "curves array<struct<branch:string,tau_s:double,gamma:double,low:double,high:double>>",
    "fits array<struct<branch:string,frequency_hz:double,zreal:double,neg_zimag:double>>",
    "sensitivity array<struct<lambda:double,selected:boolean,tau_s:double,gamma:double>>",
    "lcurve array<struct<lambda:double,residual_norm:double,roughness_norm:double,curvature:double>>",
    "evidence array<struct<tau_s:double,sign_share:double,deletion_share:double,residual_lag1:double,status:string>>",
    "secondary array<struct<peak_id:string,matched:boolean,distance_decades:double,split_or_merged:boolean>>",
    "scores array<struct<branch:string,lambda:double,prediction_percent:double,selected:boolean>>",
    "diffusion array<struct<boundary:string,accepted:boolean,best:boolean,rms_percent:double,peak_tau_s:double,sensitivity:string,supported_fraction:double,sigma:double,reason:string>>",
    "discrete array<struct<kind:string,tau_s:double,resistance:double>>",
    "reductions array<struct<model:string,accepted:boolean,selected:boolean,gain:double,aic:double,bic:double,at_bound:boolean,norm:double,peaks:string,error:string>>",
    "reduced_points array<struct<model:string,frequency_hz:double,rest_zreal:double,rest_neg_zimag:double,addback_zreal:double,addback_neg_zimag:double>>",
    "consistency array<struct<method:string,frequency_hz:double,zreal:double,neg_zimag:double,modulus:double>>",
])
TABLES = tuple(c.split()[0] for c in RESULT.split(", ") if " array<struct" in c)


def _plain(x):
    """Values as Arrow takes them: numbers that are not finite are nulls."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    x = x.item() if isinstance(x, np.generic) else x
    return None if isinstance(x, float) and not math.isfinite(x) else x


def _curve(branch: str, tau: np.ndarray, gamma: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[dict]:
    none = [None] * len(tau)
    return [{"branch": branch, "tau_s": t, "gamma": g, "low": a, "high": b} for t, g, a, b in zip(tau, gamma, none if low is None else low, none if high is None else high)]


def _points(branch: str, frequency: np.ndarray, fit: np.ndarray) -> list[dict]:
    return [{"branch": branch, "frequency_hz": f, "zreal": v.real, "neg_zimag": -v.imag} for f, v in zip(frequency, fit)]


def analyze(f: np.ndarray, z: np.ndarray, explainable: bool, nonseries: bool, diffusive: bool, options: Options = Options()) -> list[dict]:
    """One spectrum through all branches; those that need a cause (signed, diffusion, prediction, reductions) run only where the
    screens or the primary solution gave one, and have no rows elsewhere."""
    p, chosen = D.choose_inductance(f, z, explainable, policy=options.inductance_policy, order=options.derivative_order, width=options.shape_coeff)
    s = D.select_lambda(p, options.lambda_policy, fixed=options.fixed_lambda)
    lam = s["lambda"]
    r = p.solve(lam)
    cases = D.sensitivity(p, lam)
    peaks = D.classify(p, p.peaks(lam), cases)
    gap = (r["fit"] - p.measured) / np.abs(p.measured)
    out = dict.fromkeys(c.split()[0] for c in RESULT.split(", ")) | {name: [] for name in TABLES}
    out |= {"lambda": lam, "lambda_method": s["method"], "lambda_boundary": s["boundary_sensitive"], "inductance_h": r["inductance_h"], "r_inf": r["r_inf"], "rms_re_percent": 100 * np.sqrt(np.mean(gap.real**2)), "rms_im_percent": 100 * np.sqrt(np.mean(gap.imag**2))}
    low, high = D.credible_band(p, lam)
    out["curves"] = _curve("primary_drt", r["tau_s"], r["gamma"], low, high)
    out["fits"] = _points("primary_drt", p.frequency, r["fit"])
    out["lcurve"] = [dict(zip(("lambda", "residual_norm", "roughness_norm", "curvature"), row)) for row in s["lcurve"]]
    for case in cases:
        own = p.solve(case["lambda"])
        out["sensitivity"] += [{"lambda": case["lambda"], "selected": case["lambda"] == lam, "tau_s": t, "gamma": g} for t, g in zip(own["tau_s"], own["gamma"])]
    out["evidence"] = X.perturbation_evidence(f, z, lam, like=p)
    second = D.secondary(f, z)
    out["curves"] += _curve("secondary_nnls", second["tau_s"], second["gamma"])
    out["secondary"] = [{"peak_id": peaks[c["index"]]["peak_id"]} | {k: c[k] for k in ("matched", "distance_decades", "split_or_merged")} for c in D.compare_peaks(peaks, [q for q in second["peaks"] if q["relative_height"] >= 0.02])]

    kk, zhit = K.linear_kk(f, z), K.z_hit(f, z)
    out |= {"kk_rms_percent": kk["rms_percent"], "kk_status": K.kk_status(kk["rms_percent"]), "zhit_rms_percent": zhit["rms_percent"]}
    out["consistency"] = [{"method": "kk", "frequency_hz": a, "zreal": v.real, "neg_zimag": -v.imag, "modulus": abs(v)} for a, v in zip(kk["frequency_hz"], kk["fit"])]
    out["consistency"] += [{"method": "zhit", "frequency_hz": a, "zreal": None, "neg_zimag": None, "modulus": v} for a, v in zip(zhit["frequency_hz"], zhit["modulus"])]

    signed = X.signed_distribution(f, z) if nonseries else None
    if signed:
        out |= {"signed_status": "completed", "signed_sensitivity": signed["sensitivity"], "signed_rms_percent": signed["rms_percent"]}
        out["curves"] += _curve("signed_gdrt", signed["tau_s"], signed["gamma"])
        out["fits"] += _points("signed_gdrt", signed["frequency_hz"], signed["fit"])
    if diffusive:
        d = X.diffusion(f, z)
        out |= {"ddt_status": "completed", "ddt_selection": d["selection_status"], "ddt_best": d["best"]}
        for boundary, c in d["candidates"].items():
            out["diffusion"].append({"boundary": boundary, "accepted": c["accepted"], "best": boundary == d["best"], "reason": c["reason"]} | {k: c.get(k) for k in ("rms_percent", "peak_tau_s", "sensitivity", "supported_fraction", "sigma")})
            if "gamma" in c:
                out["curves"] += _curve(f"ddt:{boundary}", c["tau_s"], c["gamma"])
                out["fits"] += _points(f"ddt:{boundary}", c["frequency_hz"], c["fit"])
    try:
        m = X.loewner(f, z)
        out |= {"loewner_order": m["order"], "loewner_heldout_percent": m["heldout_percent"], "loewner_refit_percent": m["refit_percent"], "poles_incompatible": bool(m["reliable"] and m["audit"]["oscillating"] and m["heldout_percent"] < 0.8 * r["rms_percent"])}
        out |= {f"poles_{k}": v for k, v in m["audit"].items()}
        out["discrete"] = [{"kind": kind, "tau_s": t, "resistance": w} for t, w, kind in X.rc_rl_weights(m["model"])]
    except (KeyError, ValueError):
        pass
    if explainable or diffusive:
        reduced = X.reduce_model(f, z, lam, {"series_l": explainable, "diffusion": diffusive})
        out["reduced"] = reduced["selected"]
        for name, c in reduced["models"].items():
            out["reductions"].append({"model": name, "selected": name == reduced["selected"]} | {k: c.get(k) for k in ("accepted", "gain", "aic", "bic", "at_bound", "norm", "peaks", "error")})
            if "rest" in c:
                out["reduced_points"] += [{"model": name, "frequency_hz": a, "rest_zreal": b.real, "rest_neg_zimag": -b.imag, "addback_zreal": v.real, "addback_neg_zimag": -v.imag} for a, b, v in zip(c["frequency_hz"], c["rest"], c["addback"])]
    predicted = X.prediction(f, z) if (nonseries or r["rms_percent"] > 2) and len(np.unique(f)) >= 12 else None
    for name, c in (predicted or {"candidates": {}})["candidates"].items():
        out["curves"] += _curve(f"predictive_{name}", c["tau_s"], c["gamma"])
        out["fits"] += _points(f"predictive_{name}", c["frequency_hz"], c["fit"])
        out["scores"] += [{"branch": f"predictive_{name}", "lambda": v, "prediction_percent": e, "selected": v == c["lambda"]} for v, e in c["errors"]]
    out["recommended"], out["reasons"] = X.recommend(r["rms_percent"], signed["rms_percent"] if signed else None, nonseries, predicted)
    keep = ("peak_id", "tau_s", "frequency_hz", "gamma", "relative_height", "area_impedance", "persistence", "confidence")
    out["peaks"] = [{k: q[k] for k in keep} for q in peaks]
    return [_plain(out)]


def run(points: DataFrame, spectra: DataFrame, uid: str = "bigint", options: Options = Options()) -> dict[str, DataFrame]:
    """The tables of a batch from points (uid, i, frequency_hz, zreal, neg_zimag) and spectra (uid, points). Screens are relational
    and decide which branches each spectrum needs.

    results has a row for each spectrum; every other table has rows of uid and what its name says: peaks, curves (of all branches, the
    primary one with its credible band), reconstructions (of the primary branch, beside what was measured), fits (of all branches),
    recommended_curves and recommended_fits (of the branch that is recommended), sensitivity, lcurve, evidence (of peaks under
    perturbation), secondary (peaks beside those of the plain solution), scores (of predictions), diffusion (candidates), discrete
    (weights of the rational model's real poles), reductions and reduced_points, consistency, drift.

    Inversions are by far the dearest step: they are made here, once, and kept in a table of the scratch folder that all others read.
    """
    l = R.series_inductance(points).select("uid", "explainable")
    n = R.nonseries_inductance(points).select("uid", F.col("detected").alias("nonseries"))
    t = R.diffusion_tail(points).select("uid", F.col("detected").alias("diffusive"))

    def solve(f: np.ndarray, z: np.ndarray, explainable: bool, nonseries: bool, diffusive: bool) -> list[dict]:
        return analyze(f, z, explainable, nonseries, diffusive, options)

    found = written(per_spectrum(spectra.join(l, "uid").join(n, "uid").join(t, "uid"), solve, RESULT, "explainable", "nonseries", "diffusive", uid=uid), "inversions")
    tables = {name: found.select("uid", F.explode(name).alias("x")).select("uid", "x.*") for name in TABLES}
    best = found.select("uid", F.col("recommended").alias("branch"), "curves", "fits")
    of_branch = lambda name: best.select("uid", F.explode(F.filter(name, lambda x: x["branch"] == F.col("branch"))).alias("x")).select("uid", "x.*")
    fit = tables["fits"].where("branch = 'primary_drt'").select("uid", "frequency_hz", F.col("zreal").alias("fit_zreal"), F.col("neg_zimag").alias("fit_neg_zimag"))
    pairs = points.join(fit, ["uid", "frequency_hz"])
    return {
        "results": found.drop(*TABLES),
        **tables,
        "recommended_curves": of_branch("curves"),
        "recommended_fits": of_branch("fits"),
        "reconstructions": pairs.select("uid", "i", "frequency_hz", "zreal", "neg_zimag", "fit_zreal", "fit_neg_zimag"),
        "drift": R.drift_screen(pairs),
    }
