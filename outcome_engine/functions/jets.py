"""Numbers that carry their first and second derivatives, over whole numpy arrays.

A formula written with these functions gives values for plain arrays, and exact gradients and Hessians for jets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from outcome_engine.functions import special


@dataclass(frozen=True, eq=False)
class Jet:
    """Values (n,), gradients (k, n) and Hessians (k, k, n) over k variables; n may be 1 and then broadcasts."""

    v: np.ndarray
    g: np.ndarray
    h: np.ndarray

    __array_ufunc__ = None  # numpy arrays leave the operators to this class

    def __add__(self, other) -> "Jet":
        if isinstance(other, Jet):
            return Jet(self.v + other.v, self.g + other.g, self.h + other.h)
        return Jet(self.v + other, self.g, self.h)

    __radd__ = __add__

    def __neg__(self) -> "Jet":
        return Jet(-self.v, -self.g, -self.h)

    def __sub__(self, other) -> "Jet":
        return self + (-other)

    def __rsub__(self, other) -> "Jet":
        return -self + other

    def __mul__(self, other) -> "Jet":
        if not isinstance(other, Jet):
            return Jet(self.v * other, self.g * other, self.h * other)
        cross = self.g[:, None] * other.g[None]
        return Jet(self.v * other.v, self.g * other.v + other.g * self.v,
                   self.h * other.v + other.h * self.v + cross + cross.swapaxes(0, 1))

    __rmul__ = __mul__

    def __truediv__(self, other) -> "Jet":
        return self * (apply(other, lambda x: 1 / x, lambda x: -1 / x**2, lambda x: 2 / x**3) if isinstance(other, Jet) else 1.0 / other)

    def __rtruediv__(self, other) -> "Jet":
        return apply(self, lambda x: 1 / x, lambda x: -1 / x**2, lambda x: 2 / x**3) * other

    def rows(self, n: int) -> "Jet":
        """The same jet with n rows of its own."""
        k = len(self.g)
        return Jet(np.broadcast_to(self.v, (n,)), np.broadcast_to(self.g, (k, n)), np.broadcast_to(self.h, (k, k, n)))

    def at(self, index: np.ndarray) -> "Jet":
        return Jet(self.v[index], self.g[:, index], self.h[:, :, index])


def apply(x, value: Callable, first: Callable, second: Callable):
    """f(x) by the chain rule, for a jet; the plain value otherwise."""
    if not isinstance(x, Jet):
        return value(x)
    slope = first(x.v)
    return Jet(value(x.v), slope * x.g, slope * x.h + second(x.v) * (x.g[:, None] * x.g[None]))


def log_variables(point: Sequence[float]) -> list[Jet]:
    """exp(point[i]) as jets over the entries of the point."""
    size, out = len(point), []
    for i, p in enumerate(np.exp(np.asarray(point, dtype=float))):
        g, h = np.zeros((size, 1)), np.zeros((size, size, 1))
        g[i], h[i, i] = p, p
        out.append(Jet(np.array([p]), g, h))
    return out


def value(x):
    return x.v if isinstance(x, Jet) else x


def log(x):
    return apply(x, np.log, lambda v: 1 / v, lambda v: -1 / v**2)


def exp(x):
    return apply(x, np.exp, np.exp, np.exp)


def log1p(x):
    return apply(x, np.log1p, lambda v: 1 / (1 + v), lambda v: -1 / (1 + v) ** 2)


def lgamma(x):
    return apply(x, special.lgamma, special.digamma, special.trigamma)


def log1mexp(x):
    """log(1 - exp(x)) for x < 0."""
    return apply(x, lambda v: np.log(-np.expm1(v)), lambda v: 1 / -np.expm1(-v), lambda v: -np.exp(-v) / np.expm1(-v) ** 2)


def softplus(x):
    """log(1 + exp(x))."""
    def share(v):
        return np.exp(-np.logaddexp(0.0, -v))

    return apply(x, lambda v: np.logaddexp(0.0, v), share, lambda v: share(v) * share(-v))


def logaddexp(a, b):
    return a + softplus(b - a)


def where(condition: np.ndarray, a, b):
    if not isinstance(a, Jet) and not isinstance(b, Jet):
        return np.where(condition, a, b)
    a, b = a.rows(len(condition)), b.rows(len(condition))
    return Jet(np.where(condition, a.v, b.v), np.where(condition, a.g, b.g), np.where(condition, a.h, b.h))


def hyp2f1(a, b, c, z, terms: int = 20000, tol: float = 1e-15):
    """Gauss series for 0 <= z < 1; for a jet every derivative is summed until it no longer counts. Raises if a row is left.

    The series is summed with its derivatives by its own arguments, a few numbers a row and term; the chain rule to the jets'
    variables is applied once, to the sums.
    """
    if not any(isinstance(x, Jet) for x in (a, b, c, z)):
        return special.hyp2f1(a, b, c, z, terms, tol)
    args = (a, b, c, z)
    n = max(np.size(value(x)) for x in args)
    moving = [i for i in range(3) if isinstance(args[i], Jet)]  # arguments that factors (x + k) depend on
    upper = [i < 2 for i in moving]
    at = [np.array(np.broadcast_to(np.asarray(value(x), dtype=float), (n,))) for x in args]
    m, count = len(moving), len(moving) + 1  # the last derivative is that by z
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    out = np.zeros((1 + count + len(pairs), n))
    live = np.arange(n)
    # coefficient k times z to the power of max(k - 2, 0), since the second derivative by z has this power; z may be 0
    coefficient = np.ones(n)
    first, second = np.zeros((m, n)), np.zeros((m, n))  # of the coefficient's logarithm
    for k in range(terms):
        x = at[3]
        low, lower = (coefficient, 0.0) if k == 0 else (coefficient * x, coefficient) if k == 1 else (coefficient * x * x, coefficient * x)
        lowest = coefficient if k > 1 else 0.0
        part = np.zeros((len(out), live.size))
        part[0] = low
        for i in range(m):
            part[1 + i] = low * first[i]
        part[count] = k * lower
        for place, (i, j) in enumerate(pairs, 1 + count):
            if i < m and j < m:
                part[place] = low * (first[i] * first[j] + (second[i] if i == j else 0.0))
            else:
                part[place] = k * lower * first[i] if i < m else k * (k - 1.0) * lowest
        whole = out[:, live] + part if live.size < n else out + part
        if live.size < n:
            out[:, live] = whole
        else:
            out = whole
        if k > 3 and k % 4 == 0:
            size = np.abs(whole)
            small = (np.abs(part) <= tol * np.maximum(size, size[0])).all(axis=0)
            if small.any():
                stay = ~small
                live, coefficient, first, second = live[stay], coefficient[stay], first[:, stay], second[:, stay]
                at = [v[stay] for v in at]
            if live.size == 0:
                break
        for i, (argument, up) in enumerate(zip(moving, upper)):
            inverse = 1.0 / (at[argument] + k)
            first[i] += inverse if up else -inverse
            second[i] += -inverse * inverse if up else inverse * inverse
        coefficient = coefficient * ((at[0] + k) * (at[1] + k) / ((at[2] + k) * (k + 1.0)))
        if k > 1:
            coefficient = coefficient * at[3]
    else:
        raise ArithmeticError(f"the series needs over {terms} terms for z up to {at[3].max()}")
    places = [*moving, 3]
    inner = [args[i].rows(n) if isinstance(args[i], Jet) else None for i in places]
    known = next(x for x in inner if x is not None)
    g, h = np.zeros_like(known.g), np.zeros_like(known.h)
    for i, x in enumerate(inner):
        if x is not None:
            g += out[1 + i] * x.g
            h += out[1 + i] * x.h
    for place, (i, j) in enumerate(pairs, 1 + count):
        if inner[i] is not None and inner[j] is not None:
            cross = out[place] * (inner[i].g[:, None] * inner[j].g[None])
            h += cross if i == j else cross + cross.swapaxes(0, 1)
    return Jet(out[0], g, h)
