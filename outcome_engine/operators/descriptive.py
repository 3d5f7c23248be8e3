"""Descriptive statistics: exact or sketched per group, then pooled to coarser groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_engine.functions import sketches
from outcome_engine.functions.columns import join_on_nullable, ratio, safe_sqrt, total, weighted_mean
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.prefix import exact_quantiles
from outcome_engine.session import new_folder
from outcome_engine.spec import MetricSpec, unique_in_order

QUANTILES = {"Median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95}
SKETCH_QUANTILES = {**QUANTILES, "p0": 0.0, "p100": 1.0}
SKETCH = "_sketch"


def existing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in existing_columns(df, columns) if isinstance(df.schema[c].dataType, T.NumericType)]


def _common(columns, numbers) -> list:
    aggs = [F.count(c).alias(f"{c}_Count") for c in columns]
    for c in numbers:
        aggs += [total(c).alias(f"{c}_Sum"), F.avg(c).alias(f"{c}_Mean"), F.var_samp(c).alias(f"{c}_Var"),
                 F.min(c).alias(f"{c}_Min"), F.max(c).alias(f"{c}_Max")]
    return aggs


def descriptive_exact(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Exact statistics in two scans: the first also brackets the quantiles, the second counts and orders inside the brackets.
    Both read the columns needed from a written table, so what `df` is made of runs once."""
    df = apply_where(df, spec.where)
    columns, numbers = existing_columns(df, spec.columns), numeric_columns(df, spec.columns)
    aggs = _common(columns, numbers) + [F.skewness(c).alias(f"{c}_Skew") for c in numbers]
    if not numbers:
        return df.groupBy(*spec.keys).agg(*aggs)
    path = new_folder(df.sparkSession, "described")
    df.select(*unique_in_order(spec.keys, columns)).write.parquet(path)
    df = df.sparkSession.read.parquet(path)
    return exact_quantiles(df, spec.keys, numbers, QUANTILES, aggs)


def descriptive_sketch(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """The mergeable form: common statistics and one quantile sketch per numeric column."""
    df = apply_where(df, spec.where)
    columns, numbers = existing_columns(df, spec.columns), numeric_columns(df, spec.columns)
    return df.groupBy(*spec.keys).agg(
        *_common(columns, numbers), *[sketches.build(c).alias(f"{c}{SKETCH}") for c in numbers])


def descriptive(df: DataFrame, spec: MetricSpec) -> DataFrame:
    return descriptive_sketch(df, spec) if spec.use_sketch else descriptive_exact(df, spec)


def summarised_columns(stored: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if f"{c}_Mean" in stored.columns]


def pooled(stored: DataFrame, spec: MetricSpec, keys: Sequence[str], extra: Sequence = ()) -> DataFrame:
    """Counts, sums, extremes, means and variances of the coarser groups, plus `extra` aggregates.

    Var = (sum (n-1)*v + sum n*(m - M)^2) / (N - 1). The group means M are joined back to the stored
    rows, which are one per fine group; the textbook one-pass form would cancel when M is large.
    """
    numbers = summarised_columns(stored, spec.columns)
    counted = [c for c in spec.columns if f"{c}_Count" in stored.columns]
    centred = stored
    if numbers:
        means = stored.groupBy(*keys).agg(
            *[weighted_mean(f"{c}_Mean", f"{c}_Count").alias(f"__M_{c}") for c in numbers])
        centred = join_on_nullable(stored, means, keys)
    aggs = [total(f"{c}_Count").alias(f"{c}_Count") for c in counted]
    for c in numbers:
        n, m, v = F.col(f"{c}_Count"), F.col(f"{c}_Mean"), F.col(f"{c}_Var")
        gap = m - F.col(f"__M_{c}")
        spread = total((n - 1) * v) + total(n * gap * gap)
        aggs += [total(f"{c}_Sum").alias(f"{c}_Sum"), F.min(f"{c}_Min").alias(f"{c}_Min"),
                 F.max(f"{c}_Max").alias(f"{c}_Max"),
                 weighted_mean(m, n).alias(f"{c}_Mean"),
                 ratio(spread, total(n) - 1).alias(f"{c}_Var")]
    return centred.groupBy(*keys).agg(*aggs, *extra)


def averaged_quantiles(stored: DataFrame, spec: MetricSpec) -> list:
    """Count-weighted averages of stored quantiles and skews: an approximation by definition."""
    wanted = ["Median", "Skew"] + [p for p in ("p25", "p75", "p90", "p95") if p in spec.scores]
    return [weighted_mean(f"{c}_{s}", f"{c}_Count").alias(f"{c}_{s}")
            for c in summarised_columns(stored, spec.columns) for s in wanted]


def merged_sketches(stored: DataFrame, spec: MetricSpec) -> list:
    return [sketches.merge(f"{c}{SKETCH}").alias(f"{c}{SKETCH}")
            for c in summarised_columns(stored, spec.columns)]


def compact_descriptive(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    extra = merged_sketches(stored, spec) if spec.use_sketch else averaged_quantiles(stored, spec)
    return pooled(stored, spec, spec.keys, extra)


def group_descriptive(stored: DataFrame, spec: MetricSpec, group_by) -> DataFrame:
    """Descriptive aggregates go to scoring as they are stored."""
    return stored


def merge_sketches_by(stored: DataFrame, spec: MetricSpec, group_by) -> DataFrame:
    """One merged sketch per numeric column and group (the input of histograms)."""
    return stored.groupBy(*group_by).agg(*merged_sketches(stored, spec))


def with_deviation(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_Std": safe_sqrt(F.col(f"{c}_Var")) for c in numbers}) if numbers else df


def with_sketch_quantiles(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Quantiles read from the sketches, and the quartile (Bowley) skew built on them."""
    names = list(SKETCH_QUANTILES)
    for c in numbers:
        at = f"__q_{c}"
        df = df.withColumn(at, sketches.quantiles(f"{c}{SKETCH}", SKETCH_QUANTILES.values()))
        df = df.withColumns({f"{c}_{n}": F.element_at(at, i + 1) for i, n in enumerate(names)})
        q1, q2, q3 = F.col(f"{c}_p25"), F.col(f"{c}_Median"), F.col(f"{c}_p75")
        df = df.withColumn(f"{c}_Skew", ratio(q3 + q1 - 2 * q2, q3 - q1)).drop(at, f"{c}{SKETCH}")
    return df
