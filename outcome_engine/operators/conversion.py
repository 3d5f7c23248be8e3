"""Conversion counts, revenue and touchpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcome_engine.functions.columns import join_on_nullable, total
from outcome_engine.operators.engagement import sum_counts
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.labels import LABEL, best_outcome_cells, label_outcomes
from outcome_engine.spec import CONVERSION_EVENT_ID, REVENUE, SUBJECT_ID, MetricSpec, unique_in_order

TOUCH_KEYS = [SUBJECT_ID, CONVERSION_EVENT_ID]
MEASURES = ("Negatives", "Positives", "Revenue", "Count", "Touchpoints")


def touchpoints(labelled: DataFrame) -> DataFrame:
    """Positives per (customer, conversion event), counted before the best outcome is chosen."""
    return labelled.filter(F.col(LABEL) == 1).groupBy(*TOUCH_KEYS).agg(F.count("*").alias("Touchpoints"))


def conversion(ih: DataFrame, spec: MetricSpec) -> DataFrame:
    """Every kept row, negative or positive, carries the touchpoints of its (customer, event).

    Rows are first summed per (dimensions, customer, event), so the join meets one row per cell
    however many events a customer has; the touchpoints are then weighted by the cell's rows.
    """
    labelled = label_outcomes(apply_where(ih, spec.where), spec.positive, spec.negative)
    dims = unique_in_order(spec.keys, TOUCH_KEYS)
    cells = best_outcome_cells(labelled, dims, [REVENUE]).groupBy(*dims).agg(
        total("Count").alias("Count"), total(REVENUE).alias("Revenue"), total("Positives").alias("Positives"))
    # A NULL customer or event has no touchpoints: NULL keys do not match each other here.
    joined = join_on_nullable(cells, touchpoints(labelled).dropna(subset=TOUCH_KEYS), TOUCH_KEYS, "left")
    summed = joined.groupBy(*spec.keys).agg(
        total("Count").alias("Count"),
        total("Revenue").alias("Revenue"),
        total(F.col("Touchpoints") * F.col("Count")).alias("Touchpoints"),
        total("Positives").alias("Positives"),
    )
    return summed.withColumn("Negatives", F.col("Count") - F.col("Positives"))


def compact_conversion(stored: DataFrame, spec: MetricSpec, drop_one_sided: bool = False) -> DataFrame:
    """Sums per dimension tuple. `drop_one_sided` leaves out rows without negatives before they are summed, and with them
    the positives and revenue of loads that saw only these."""
    kept = stored.filter(F.col("Negatives") > 0) if drop_one_sided else stored
    return sum_counts(kept, spec.keys, MEASURES) if spec.keys or not drop_one_sided else kept


def group_conversion(stored: DataFrame, spec: MetricSpec, group_by) -> DataFrame:
    """Regroup before scoring; this form has no touchpoints. Loads are summed first: a tuple without negatives in any is left out."""
    kept = sum_counts(stored, spec.keys, MEASURES).filter(F.col("Negatives") > 0)
    return sum_counts(kept, unique_in_order(group_by, spec.global_filters),
                      ("Negatives", "Positives", "Revenue", "Count"))
