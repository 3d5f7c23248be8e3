"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den; NULL when den is 0."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def total(c: Column | str) -> Column:
    """Sum that is 0, not NULL, over nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Aggregate: sum(w*x)/sum(w) over rows where x is known."""
    x, w = col(x), col(w)
    known = F.when(x.isNotNull(), w)
    return ratio(F.sum(w * x), F.sum(known))


def count_values(c: Column | str) -> Column:
    """Aggregate: number of different values, NULL being one of them."""
    c = col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def join_on_nullable(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other; the key columns of `left` are kept.

    `<=>` stays an equi-join for Spark (on the keys with NULL replaced), so both sides are shuffled
    for the join and AQE may broadcast a side it measured to be small or split a skewed partition.
    """
    if not keys:
        raise ValueError("join needs keys")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def round_columns(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})
