"""Engagement and experiment counts: positives and negatives per dimension set and arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcome_engine.functions.columns import total
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.labels import best_outcome_cells, label_outcomes
from outcome_engine.spec import MetricSpec, unique_in_order

COUNTS = ("Count", "Positives", "Negatives")


def sum_counts(df: DataFrame, keys, names=COUNTS) -> DataFrame:
    return df.groupBy(*keys).agg(*[total(n).alias(n) for n in names])


def engagement(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    labelled = label_outcomes(apply_where(ih, spec.where), spec.positive, spec.negative)
    counted = sum_counts(best_outcome_cells(labelled, spec.keys), spec.keys, ("Count", "Positives"))
    return counted.withColumn("Negatives", F.col("Count") - F.col("Positives"))


def compact_engagement(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    return sum_counts(stored, spec.keys)


def experiment(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    return engagement(ih, spec).filter(F.col("Count") > 0)


def compact_experiment(stored: DataFrame, spec: MetricSpec, drop_one_sided: bool = False) -> DataFrame:
    """Sums per dimension tuple. `drop_one_sided` leaves out tuples without positives or negatives, which a later load may
    still complete; scoring leaves them out anyway."""
    summed = sum_counts(stored, spec.keys)
    return summed.filter((F.col("Positives") > 0) & (F.col("Negatives") > 0)) if drop_one_sided else summed


def group_engagement(stored: DataFrame, spec: MetricSpec, group_by) -> DataFrame:
    """Regroup before scoring: chosen dimensions and global filters, always split by arm."""
    return sum_counts(stored, unique_in_order(group_by, spec.global_filters, "ModelControlGroup"))


def group_experiment(stored: DataFrame, spec: MetricSpec, group_by) -> DataFrame:
    keys = unique_in_order(spec.global_filters, group_by, spec.experiment_name, spec.experiment_group)
    return sum_counts(stored, keys).filter((F.col("Positives") > 0) & (F.col("Negatives") > 0))
