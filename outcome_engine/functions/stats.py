"""Significance tests as column expressions (no Python in the hot path)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcome_engine.functions.columns import col, ratio, safe_sqrt

# Published rational approximations of erf/erfc (W. J. Cody, Math. Comp. 23, 1969).
ERF_SMALL_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
                 3.77485237685302021e2, 3.20937758913846947e3)
ERF_SMALL_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2,
                 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
                6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
                1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
                1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
                3.43936767414372164e3, 1.23033935480374942e3)
ERFC_FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
                1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_FAR_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
                6.05183413124413191e-2, 2.33520497626869185e-3)
Z_975 = 1.959963984540054


def _polynomial(coefficients, x: str) -> str:
    """Horner form, highest power first, as SQL text."""
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def _erfc_text(x: str) -> str:
    """The argument is bound once as a lambda variable; erfc(-a) = 2 - erfc(a) is folded in by its sign."""
    square, inverse = "(__a * __a)", "try_divide(1.0D, __a * __a)"
    near = f"1.0D - __a * {_polynomial(ERF_SMALL_NUM, square)} / {_polynomial(ERF_SMALL_DEN, square)}"
    mid = f"exp(-{square}) * {_polynomial(ERFC_MID_NUM, '__a')} / {_polynomial(ERFC_MID_DEN, '__a')}"
    tail = f"{inverse} * {_polynomial(ERFC_FAR_NUM, inverse)} / {_polynomial(ERFC_FAR_DEN, inverse)}"
    far = f"exp(-{square}) * try_divide({1.0 / math.sqrt(math.pi)!r}D - {tail}, __a)"
    positive = f"CASE WHEN __a <= 0.46875D THEN {near} WHEN __a <= 4.0D THEN {mid} ELSE {far} END"
    return (f"element_at(transform(transform(array({x}), __x -> named_struct('s', sign(__x), 'a', abs(__x))), "
            f"__y -> (1.0D - __y.s) + __y.s * element_at(transform(array(__y.a), __a -> {positive}), 1)), 1)")


def erfc(x: str) -> Column:
    """Complementary error function of a SQL expression, e.g. a column name.

    The text form is parsed once in the JVM; built from Column objects it would take hundreds of calls.
    """
    return F.expr(_erfc_text(f"CAST({x} AS DOUBLE)"))


def normal_two_tailed(z: str) -> Column:
    return erfc(f"abs({z}) / {math.sqrt(2.0)!r}D")


def chi2_survival(x: str, dof: str | int) -> Column:
    """P(X > x) for chi-square with integer dof, by the finite recurrence. x and dof are column names."""
    half_text = f"(greatest(CAST({x} AS DOUBLE), 0.0D) / 2)"
    if dof == 1:
        return erfc(f"sqrt({half_text})")
    half, dof = F.expr(half_text), col(dof) if isinstance(dof, str) else F.lit(dof)
    steps = F.floor(dof / 2).cast("int")

    def series(first: Column, divisor) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
        run = F.aggregate(
            F.sequence(F.lit(1), steps), start,
            lambda acc, j: F.struct((acc["term"] * half / divisor(j)).alias("term"),
                                    (acc["sum"] + acc["term"]).alias("sum")),
        )
        return F.when(steps >= 1, run["sum"]).otherwise(F.lit(0.0))

    even = series(F.exp(-half), lambda j: j.cast("double"))
    odd_first = F.sqrt(half) * F.exp(-half) * F.lit(2.0 / math.sqrt(math.pi))
    odd = erfc(f"sqrt({half_text})") + series(odd_first, lambda j: j + F.lit(0.5))
    value = F.when(dof % 2 == 0, even).otherwise(odd)
    unknown = F.expr(f"{x} IS NULL") | dof.isNull()
    return F.when(unknown, F.lit(None).cast("double")).when(dof <= 0, F.lit(1.0)).otherwise(value)


def _any_zero(*counts: Column) -> Column:
    zero = F.lit(False)
    for c in counts:
        zero = zero | (c == 0)
    return zero


def proportions_z(c1, c2, n1, n2) -> Column:
    """z of two proportions with pooled variance; 0 when any argument is 0.

    NULL where the pooled share leaves (0, 1), for then the variance is not positive.
    """
    c1, c2, n1, n2 = (col(c).cast("double") for c in (c1, c2, n1, n2))
    pooled = ratio(c1 + c2, n1 + n2)
    variance = pooled * (1 - pooled) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2))
    z = ratio(ratio(c1, n1) - ratio(c2, n2), F.when(variance > 0, F.sqrt(variance)))
    return F.when(_any_zero(c1, c2, n1, n2), F.lit(0.0)).otherwise(z)


def with_ztest(df: DataFrame, c1: str, c2: str, n1: str, n2: str, z_name: str = "z_score",
               p_name: str = "z_p_val", two_tailed: bool = True) -> DataFrame:
    """Add z and p; both are 0 when any count is 0. Counts are column names.

    z is a column of its own before p is built on it: the tail approximation names its argument many
    times, and a reference costs nothing where a repeated expression would blow up the plan.
    """
    counts = [F.col(c) for c in (c1, c2, n1, n2)]
    scored = df.withColumn(z_name, proportions_z(c1, c2, n1, n2))
    p = normal_two_tailed(z_name)
    return scored.withColumn(p_name, F.when(_any_zero(*counts), F.lit(0.0)).otherwise(p if two_tailed else p / 2))


def _observed_log_ratio(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.ln(ratio(observed, expected))).otherwise(F.lit(0.0))


def g_proportions(c1, c2, n1, n2) -> Column:
    """G of two proportions given successes and group sizes; 0 when any argument is 0."""
    c1, c2, n1, n2 = (col(c).cast("double") for c in (c1, c2, n1, n2))
    f1, f2, size = n1 - c1, n2 - c2, n1 + n2
    success, failure = ratio(c1 + c2, size), ratio(f1 + f2, size)
    g = (g_term(c1, n1 * success) + g_term(f1, n1 * failure)
         + g_term(c2, n2 * success) + g_term(f2, n2 * failure))
    return F.when(_any_zero(c1, c2, n1, n2), F.lit(0.0)).otherwise(g)


def with_gtest(df: DataFrame, c1: str, c2: str, n1: str, n2: str) -> DataFrame:
    """Add g_stat and g_p_val (one degree of freedom); both are 0 when any count is 0."""
    zero = _any_zero(*[F.col(c) for c in (c1, c2, n1, n2)])
    scored = df.withColumn("g_stat", g_proportions(c1, c2, n1, n2))
    return scored.withColumn("g_p_val", F.when(zero, F.lit(0.0)).otherwise(chi2_survival("g_stat", 1)))


def chi2_term(observed: Column, expected: Column) -> Column:
    return ratio((observed - expected) * (observed - expected), expected)


def g_term(observed: Column, expected: Column) -> Column:
    return 2 * _observed_log_ratio(observed, expected)


def odds_ratio(a, b, c, d) -> tuple[Column, Column, Column]:
    """Sample odds ratio of [[a, b], [c, d]] with its 95 % interval."""
    a, b, c, d = (col(v).cast("double") for v in (a, b, c, d))
    odds = ratio(a * d, b * c)
    spread = F.lit(Z_975) * safe_sqrt(ratio(F.lit(1.0), a) + ratio(F.lit(1.0), b)
                                      + ratio(F.lit(1.0), c) + ratio(F.lit(1.0), d))
    return odds, F.exp(F.ln(odds) - spread), F.exp(F.ln(odds) + spread)
