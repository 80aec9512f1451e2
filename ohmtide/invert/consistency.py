"""Consistency of a spectrum with causality and linearity: a linear Kramers-Kronig fit, and the Hilbert relation of phase and modulus."""

from __future__ import annotations

import math

import numpy as np

from ohmtide.numerics.curves import relative_rms

GATES = {"drt": (0.5, 1.0), "eis": (1.0, 3.0)}


def linear_kk(frequency: np.ndarray, z: np.ndarray, capacitance: bool = True, admittance: bool = False, most: int | None = None, limit: float = 0.85) -> dict:
    """A chain of RC elements at fixed times with R, L and 1/C, by weighted least squares; elements are added until they begin to
    cancel each other (mu, one minus the share of negative resistances, falls under the limit) or there are as many as points. It begins
    with three elements a decade: fewer can't follow a process between them.
    In the admittance form 1/Z is fitted, with its own weights."""
    order = np.argsort(-np.asarray(frequency, float))
    f, z = np.asarray(frequency, float)[order], np.asarray(z, complex)[order]
    if len(f) < 5 or (f <= 0).any() or (np.abs(z) == 0).any():
        raise ValueError("a consistency fit needs at least five points of positive frequency and nonzero impedance")
    target = 1 / z if admittance else z
    omega = 2 * math.pi * f
    weight = 1 / np.abs(target)
    best = None
    first = min(max(3, math.ceil(3 * math.log10(f.max() / f.min()))), len(f))
    for m in range(first, max(most or len(f), first) + 1):
        tau = np.geomspace(1 / omega.max(), 1 / omega.min(), m)
        rc = 1 / (1 + 1j * omega[:, None] * tau[None, :])
        parts = [np.ones(len(f), complex), 1j * omega / omega.max()] + ([omega.min() / (1j * omega)] if capacitance else []) + list((rc * (1j * omega[:, None] * tau[None, :]) if admittance else rc).T)
        a = np.column_stack(parts) * weight[:, None]
        x = np.linalg.lstsq(np.vstack([a.real, a.imag]), np.concatenate([(target * weight).real, (target * weight).imag]), rcond=1e-12)[0]
        r = x[-m:]
        mu = 1 - np.abs(r[r < 0]).sum() / max(np.abs(r[r >= 0]).sum(), 1e-300)
        fit = np.column_stack(parts) @ x
        fit = 1 / fit if admittance else fit
        best = {"elements": m, "mu": float(mu), "fit": fit, "frequency_hz": f, "measured": z, "rms_percent": relative_rms(z, fit)}
        if mu < limit:
            break
    return best


def kk_status(rms: float, path: str = "drt") -> str:
    warn, block = GATES[path]
    return "screen-pass" if rms <= warn else "warn" if rms <= block else "suspect"


def z_hit(frequency: np.ndarray, z: np.ndarray) -> dict:
    """ln|Z| from the phase: its integral over ln omega and the slope of the phase, with the constant from the middle of the sweep."""
    order = np.argsort(np.asarray(frequency, float))
    f, z = np.asarray(frequency, float)[order], np.asarray(z, complex)[order]
    if len(f) < 5:
        raise ValueError("too few points")
    x, phase = np.log(2 * math.pi * f), np.unwrap(np.angle(z))
    integral = np.concatenate([[0.0], np.cumsum(np.diff(x) * (phase[1:] + phase[:-1]) / 2)])
    log = 2 / math.pi * integral - math.pi / 6 * np.gradient(phase, x)
    measured = np.log(np.abs(z))
    a, b = len(f) // 5, len(f) - len(f) // 5
    log += np.mean(measured[a:b] - log[a:b])
    inner = slice(1, -1)
    return {"frequency_hz": f, "modulus": np.exp(log), "rms_percent": float(100 * np.sqrt(np.mean((np.exp(log - measured)[inner] - 1) ** 2)))}
