"""Purchase models: BG/NBD, Pareto/NBD and Gamma-Gamma, fitted by Spark aggregations.

Customers with equal (frequency, recency, tenure) are counted together first. Each optimiser step is
one Spark job that returns the sums of log-likelihood, gradient and Hessian at one point, from exact derivatives; the driver
only ever holds those sums. Formulas: Fader, Hardie & Lee (2005); Schmittlein, Morrison & Colombo
(1987); Fader & Hardie (2005, Gamma-Gamma).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcome_engine.functions import jets
from outcome_engine.functions.columns import ratio
from outcome_engine.functions.jets import hyp2f1, lgamma, log, logaddexp
from outcome_engine.session import cut_lineage

DAYS_PER_PERIOD = 30
CELL = ["frequency", "recency", "tenure"]


@dataclass(frozen=True)
class FittedModel:
    kind: str
    params: tuple[float, ...]
    nll: float
    errors: tuple[float, ...] = ()  # standard errors of the parameters, from the Hessian of the fitted objective
    jobs: int = 0  # Spark jobs of the optimiser


# ---- log-likelihoods per row ------------------------------------------------------------------
# Parameters are numbers or jets; histories are arrays.


def bgnbd_loglik(params, x, recency, age):
    r, alpha, a, b = params
    first = lgamma(r + x) - lgamma(r) + r * log(alpha)
    second = lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    alive = -(r + x) * log(alpha + age)
    dead = log(a) - log(b + (np.maximum(x, 1) - 1)) - (r + x) * log(alpha + recency)
    return first + second + jets.where(x > 0, logaddexp(alive, dead), alive)


def _log_pareto_integral(params, x, recency, age):
    r, alpha, s, beta = params
    below = bool(np.all(jets.value(alpha) < jets.value(beta)))
    big, gap = (beta, beta - alpha) if below else (alpha, alpha - beta)
    t = r + x if below else s + 1 + np.zeros_like(x)
    rsx = r + s + x

    def part(time):
        # Euler's transform keeps the series terms positive and bounded.
        z = gap / (big + time)
        return ((1 - t) * jets.log1p(-z) + log(hyp2f1(np.ones_like(x), rsx + 1 - t, rsx + 1, z))
                - rsx * log(big + time))

    high, low = part(recency), part(age)
    # A last purchase on the last day leaves no time to have gone since: the integral is 0.
    some = jets.value(low) < jets.value(high)
    fall = jets.where(some, low - high, (low - high) * 0.0 - 1.0)
    return jets.where(some, high + jets.log1mexp(fall), high - 690.0)


def pareto_loglik(params, x, recency, age):
    r, alpha, s, beta = params
    lead = lgamma(r + x) - lgamma(r) + r * log(alpha) + s * log(beta)
    alive = -(r + x) * log(alpha + age) - s * log(beta + age)
    dead = log(s) + _log_pareto_integral(params, x, recency, age) - log(r + s + x)
    return lead + logaddexp(alive, dead)


def gamma_gamma_loglik(params, x, money):
    p, q, v = params
    return (lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * log(v) + (p * x - 1) * np.log(money)
            + p * x * np.log(x) - (p * x + q) * log(v + x * money))


# ---- fitting ------------------------------------------------------------------------------------


def batch_derivatives(cells: DataFrame, loglik: Callable, columns: Sequence[str]) -> Callable:
    """point (logs of the parameters) -> weighted sums of log-likelihood, gradient and Hessian, one Spark job per call."""

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        size, logs = len(point), [float(p) for p in point]

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(1 + size + size * size)
            for pdf in frames:
                values = [pdf[c].to_numpy(dtype=float) for c in columns]
                weight = pdf["n"].to_numpy(dtype=float)
                if len(weight):
                    with np.errstate(all="ignore"):
                        found = loglik(jets.log_variables(logs), *values).rows(len(weight))
                        sums += np.concatenate([[found.v @ weight], found.g @ weight, (found.h @ weight).ravel()])
            yield pd.DataFrame({"k": np.arange(len(sums)), "s": sums})

        parts = cells.mapInPandas(partial, "k int, s double").groupBy("k").agg(F.sum("s").alias("s"))
        sums = np.full(1 + size + size * size, np.nan)
        for row in parts.collect():
            sums[row["k"]] = row["s"]
        return sums[0], sums[1:1 + size], sums[1 + size:].reshape(size, size)

    return evaluate


FLAT = 1e-7  # slope below which a point counts as the optimum
HALVINGS = 8


def minimise(objective: Callable, start: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Damped Newton over (value, gradient, Hessian): point, value, Hessian there and the number of calls.

    A step that does not lower the value is shortened. Returns only a point with a flat slope, or one that no step improves
    although its slope is nearly flat; otherwise it raises.
    """
    point = np.asarray(start, dtype=float)
    best, gradient, hessian = objective(point)
    calls = 1
    for _ in range(rounds):
        if not (np.isfinite(best) and np.all(np.isfinite(gradient)) and np.all(np.isfinite(hessian))):
            raise ArithmeticError(f"the likelihood is not finite around {point}")
        if np.max(np.abs(gradient)) < FLAT:
            return point, float(best), hessian, calls
        values, vectors = np.linalg.eigh(hessian)
        floor = max(1e-8, 1e-6 * np.max(np.abs(values)))
        move = -vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), floor))
        move *= min(1.0, 3.0 / max(np.max(np.abs(move)), 1e-12))
        for _ in range(HALVINGS):
            tried = objective(point + move)
            calls += 1
            if np.isfinite(tried[0]) and tried[0] < best and np.all(np.isfinite(tried[2])):
                break
            move = move * 0.25
        else:
            if np.max(np.abs(gradient)) < 1000 * FLAT:
                return point, float(best), hessian, calls
            raise ArithmeticError(f"no step improves the fit at {point}, slope {gradient}")
        point, (best, gradient, hessian) = point + move, tried
    raise ArithmeticError(f"no fit after {rounds} rounds; at {point}")


def _fit(kind: str, cells: DataFrame, loglik: Callable, columns: Sequence[str], start: Sequence[float],
         penalty: float, count: float) -> FittedModel:
    """`start` holds logs of the parameters."""
    evaluate = batch_derivatives(cells, loglik, columns)

    def objective(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            total, gradient, hessian = evaluate(point)
            squares = penalty * np.exp(2 * point)
            return -total / count + squares.sum(), -gradient / count + 2 * squares, -hessian / count + np.diag(4 * squares)

    point, best, hessian, calls = minimise(objective, np.array(start, dtype=float))
    params = np.exp(point)
    spread = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0.0) / count)
    return FittedModel(kind, tuple(params.tolist()), best, tuple((params * spread).tolist()), calls)


def purchase_cells(rfm: DataFrame) -> DataFrame:
    """Repeat buyers, counted per (frequency, recency, tenure)."""
    return (rfm.filter(F.col("frequency") > 0)
            .groupBy(*[F.col(c).cast("double").alias(c) for c in CELL]).agg(F.count("*").alias("n")))


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells written once and dealt evenly: they are few bytes, but each costs long series, so they must not share one task."""
    return cut_lineage(cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def fit_purchases(rfm: DataFrame, kind: str = "bgnbd", penalty: float = 0.001) -> FittedModel:
    """BG/NBD or Pareto/NBD. Times are scaled to a longest tenure of 10 while fitting."""
    cells = _dealt(purchase_cells(rfm))
    longest, count = cells.agg(F.max("tenure"), F.sum("n")).first()
    if not count:
        raise ValueError("no customer with repeat purchases")
    scale = 10.0 / longest
    scaled = cells.withColumns({"recency": F.col("recency") * scale, "tenure": F.col("tenure") * scale})
    loglik = {"bgnbd": bgnbd_loglik, "pareto": pareto_loglik}[kind]
    found = _fit(kind, scaled, loglik, CELL, (0.1, 0.1, 0.1, 0.1), penalty, count)
    times = (1,) if kind == "bgnbd" else (1, 3)
    params, errors = ([v / scale if i in times else v for i, v in enumerate(vs)] for vs in (found.params, found.errors))
    return FittedModel(kind, tuple(params), found.nll, tuple(errors), found.jobs)


def fit_gamma_gamma(rfm: DataFrame, penalty: float = 0.01) -> FittedModel:
    cells = _dealt(rfm.filter((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
                   .groupBy(F.col("frequency").cast("double").alias("frequency"),
                            F.col("monetary_value").cast("double").alias("monetary_value"))
                   .agg(F.count("*").alias("n")))
    count = cells.agg(F.sum("n")).first()[0]
    if not count:
        raise ValueError("no customer with repeat purchases")
    return _fit("gamma_gamma", cells, gamma_gamma_loglik, ["frequency", "monetary_value"], (0.5, 0.5, 0.5), penalty, count)


# ---- prediction -----------------------------------------------------------------------------------


def bgnbd_expected(params, t, x, recency, age) -> np.ndarray:
    """Expected purchases in the next t days given a customer's history."""
    r, alpha, a, b = params
    z = t / (alpha + age + t)
    inner = np.exp((a - 1) * np.log1p(-z)) * hyp2f1(a + b - 1 - r, a - 1, a + b + x - 1, z)
    share_alive = 1 + np.where(x > 0, a / (b + np.maximum(x, 1) - 1)
                               * np.exp((r + x) * np.log((alpha + age) / (alpha + recency))), 0.0)
    return (a + b + x - 1) / (a - 1) * (1 - inner) / share_alive


def pareto_expected(params, t, x, recency, age) -> np.ndarray:
    r, alpha, s, beta = params
    lead = (lgamma(r + x) - lgamma(r) + r * np.log(alpha) + s * np.log(beta)
            - (r + x) * np.log(alpha + age) - s * np.log(beta + age) - pareto_loglik(params, x, recency, age))
    growth = -np.expm1((s - 1) * np.log((beta + age) / (beta + age + t))) / (s - 1)
    return np.exp(lead) * (r + x) * (beta + age) / (alpha + age) * growth


EXPECTED = {"bgnbd": bgnbd_expected, "pareto": pareto_expected}


def expected_purchases(model: FittedModel, days: float):
    """Column function (frequency, recency, tenure) -> expected purchases."""
    predict, params = EXPECTED[model.kind], model.params

    @F.pandas_udf("double")
    def score(x: pd.Series, recency: pd.Series, age: pd.Series) -> pd.Series:
        return pd.Series(predict(params, float(days), *(v.to_numpy(dtype=float) for v in (x, recency, age))))

    return score


def discounted_purchases(model: FittedModel, periods: int, rate: float = 0.01):
    """Column function: expected purchases of each 30-day period, discounted and summed."""
    predict, params = EXPECTED[model.kind], model.params

    @F.pandas_udf("double")
    def score(x: pd.Series, recency: pd.Series, age: pd.Series) -> pd.Series:
        history = [v.to_numpy(dtype=float) for v in (x, recency, age)]
        before, value = np.zeros(len(x)), np.zeros(len(x))
        for i in range(1, periods + 1):
            now = predict(params, float(i * DAYS_PER_PERIOD), *history)
            value += (now - before) / (1 + rate) ** i
            before = now
        return pd.Series(value)

    return score


def expected_profit(model: FittedModel, x: str = "frequency", money: str = "monetary_value"):
    """Gamma-Gamma expected average value per purchase, a plain column expression."""
    p, q, v = model.params
    weight = F.lit(p) * F.col(x) / (F.lit(p) * F.col(x) + F.lit(q - 1))
    return (1 - weight) * F.lit(v * p / (q - 1)) + weight * F.col(money)


def with_expected_purchases(rfm: DataFrame, model: FittedModel, days: float) -> DataFrame:
    buyers = rfm.filter(F.col("frequency") > 0)
    return buyers.withColumn("expected_number_of_purchases", expected_purchases(model, days)(*CELL))


def loglik_by_segment(rfm: DataFrame, kind: str, params: Sequence[float]) -> DataFrame:
    """Log-likelihood of given parameters per segment: to compare models, or one model on other customers."""
    columns = ["frequency", "monetary_value"] if kind == "gamma_gamma" else CELL
    loglik = {"bgnbd": bgnbd_loglik, "pareto": pareto_loglik, "gamma_gamma": gamma_gamma_loglik}[kind]

    @F.pandas_udf("double")
    def each(*values: pd.Series) -> pd.Series:
        return pd.Series(loglik(tuple(params), *(v.to_numpy(dtype=float) for v in values)))

    buyers = rfm.filter((F.col("frequency") > 0) & (F.col(columns[1]) > 0))
    cells = buyers.groupBy("rfm_segment", *columns).agg(F.count("*").alias("n"))
    return cells.groupBy("rfm_segment").agg(F.sum("n").alias("customers"), F.sum(F.col("n") * each(*columns)).alias("loglik"))


def purchases_by_segment(rfm: DataFrame, kind: str = "bgnbd", years: int = 1) -> DataFrame:
    """Mean expected purchases per segment; predictions are made once per distinct history."""
    model = fit_purchases(rfm, kind)
    cells = rfm.filter(F.col("frequency") > 0).groupBy("rfm_segment", *CELL).agg(F.count("*").alias("n"))
    scored = cells.withColumn("e", expected_purchases(model, 365 * years)(*CELL))
    return scored.groupBy("rfm_segment").agg(
        ratio(F.sum(F.col("e") * F.col("n")), F.sum("n")).alias("expected_number_of_purchases"))


def value_by_segment(rfm: DataFrame, years: int = 1, rate: float = 0.01) -> DataFrame:
    """Mean discounted lifetime value per segment over 365 * years periods."""
    purchases, profit = fit_purchases(rfm, "bgnbd"), fit_gamma_gamma(rfm)
    cells = rfm.filter(F.col("frequency") > 0).groupBy("rfm_segment", *CELL).agg(
        F.count("*").alias("n"), F.sum(expected_profit(profit)).alias("profit"))
    scored = cells.withColumn("d", discounted_purchases(purchases, 365 * years, rate)(*CELL))
    return scored.groupBy("rfm_segment").agg(
        ratio(F.sum(F.col("d") * F.col("profit")), F.sum("n")).alias("expected_lifetime_value"))
