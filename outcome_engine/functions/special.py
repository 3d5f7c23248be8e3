"""Vectorised special functions for the purchase models (numpy only, run inside tasks)."""

from __future__ import annotations

import math

import numpy as np

# Stirling series coefficients B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def lgamma(x) -> np.ndarray:
    """log Gamma for x > 0: shift to x >= 10, then the Stirling series."""
    x = np.asarray(x, dtype=float)
    shift = np.maximum(0, np.ceil(10.0 - x)).astype(int)
    product = np.ones_like(x)
    for i in range(int(shift.max(initial=0))):
        product = np.where(i < shift, product * (x + i), product)
    y = x + shift
    inverse = 1.0 / (y * y)
    series = np.zeros_like(y)
    for c in reversed(STIRLING):
        series = series * inverse + c
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series / y - np.log(product)


def _shifted(x, power: int) -> tuple[np.ndarray, np.ndarray]:
    """x moved up to at least 10, and the sum of 1 / (x + i)^power over the steps."""
    x = np.asarray(x, dtype=float)
    shift = np.maximum(0, np.ceil(10.0 - x)).astype(int)
    steps = np.zeros_like(x)
    for i in range(int(shift.max(initial=0))):
        steps = steps + np.where(i < shift, 1.0 / (x + i) ** power, 0.0)
    return x + shift, steps


def digamma(x) -> np.ndarray:
    """Derivative of log Gamma for x > 0: that of the Stirling series, term by term."""
    y, steps = _shifted(x, 1)
    series = sum(c * (2 * k + 1) / y ** (2 * k + 2) for k, c in enumerate(STIRLING))
    return np.log(y) - 0.5 / y - series - steps


def trigamma(x) -> np.ndarray:
    """Second derivative of log Gamma for x > 0."""
    y, steps = _shifted(x, 2)
    series = sum(c * (2 * k + 1) * (2 * k + 2) / y ** (2 * k + 3) for k, c in enumerate(STIRLING))
    return 1.0 / y + 0.5 / y**2 + series + steps


def hyp2f1(a, b, c, z, terms: int = 20000, tol: float = 1e-15) -> np.ndarray:
    """Gauss series for 0 <= z < 1; elements leave the loop once their term no longer counts. Raises if one is left."""
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, c, z)))
    out, term = np.ones(a.shape), np.ones(a.shape)
    flat = [v.ravel() for v in (a, b, c, z)]
    total, last = out.ravel(), term.ravel()
    live = np.arange(total.size)
    for k in range(terms):
        aa, bb, cc, zz = (v[live] for v in flat)
        last[live] = last[live] * (aa + k) * (bb + k) / ((cc + k) * (k + 1)) * zz
        total[live] += last[live]
        if k > 3:
            live = live[np.abs(last[live]) > tol * np.abs(total[live])]
            if live.size == 0:
                return total.reshape(a.shape)
    if live.size:
        raise ArithmeticError(f"the series needs over {terms} terms for z up to {flat[3][live].max()}")
    return total.reshape(a.shape)
