"""Outcome labels shared by the engagement, conversion, experiment and model metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outcome_engine.spec import INTERACTION_KEYS, OUTCOME, unique_in_order

LABEL = "Outcome_Binary"


def restrict_outcomes(df: DataFrame, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    return df.filter(F.col(OUTCOME).isin([*negative, *positive]))


def with_label(df: DataFrame, positive: Sequence[str]) -> DataFrame:
    return df.withColumn(LABEL, F.when(F.col(OUTCOME).isin(list(positive)), 1).otherwise(0))


def label_outcomes(df: DataFrame, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    return with_label(restrict_outcomes(df, positive, negative), positive)


def keep_best_outcome(labelled: DataFrame, keys: Sequence[str] = INTERACTION_KEYS) -> DataFrame:
    """Rows whose label equals the largest label of their (interaction, action, rank); ties all stay.

    The label is 0 or 1, so these are the positives plus the negatives whose key has no positive.
    That is a left join with the distinct positive keys instead of a window: the right side has one
    row per key, AQE may broadcast it after measuring it, and a key that holds a large share of the
    rows is split by AQE's skew join rather than sorted by one task. The key is one struct, since
    structs with NULL fields compare equal. It is built after `distinct`: AQE splits a skewed join only
    where both sides come straight from a shuffle, so the small side is shuffled once more.
    """
    keyed = labelled.withColumn("__key", F.struct(*keys))
    won = labelled.filter(F.col(LABEL) == 1).select(*keys).distinct().select(F.struct(*keys).alias("__won"))
    joined = keyed.join(won, F.col("__key") == F.col("__won"), "left")
    return joined.filter((F.col(LABEL) == 1) | F.col("__won").isNull()).drop("__key", "__won")


def best_outcome_cells(labelled: DataFrame, dims: Sequence[str], sums: Sequence[str] = (),
                       keys: Sequence[str] = INTERACTION_KEYS) -> DataFrame:
    """What `keep_best_outcome` keeps, counted: a row for each (interaction key, dims) with Count, Positives and `sums`.

    One pass: rows are counted per key and dimensions first, combined before the shuffle, so that a key that holds a large
    share of the rows has shrunk to a few cells when the window looks for its positives.
    """
    names = unique_in_order(keys, dims)
    won = F.col(LABEL) == 1
    cells = labelled.groupBy(*names).agg(
        F.count("*").alias("__rows"), F.count(F.when(won, 1)).alias("Positives"),
        *[F.sum(c).alias(f"__all_{c}") for c in sums], *[F.sum(F.when(won, F.col(c))).alias(f"__won_{c}") for c in sums])
    any_won = F.max("Positives").over(Window.partitionBy(*keys)) > 0
    kept = cells.withColumn("__any", any_won).filter(~F.col("__any") | (F.col("Positives") > 0))
    return kept.select(*names, F.when(F.col("__any"), F.col("Positives")).otherwise(F.col("__rows")).alias("Count"), "Positives",
                       *[F.when(F.col("__any"), F.col(f"__won_{c}")).otherwise(F.col(f"__all_{c}")).alias(c) for c in sums])


def keep_groups_with_positive(df: DataFrame, keys: Sequence[str], labelled: DataFrame | None = None) -> DataFrame:
    """Rows of key groups that hold at least one positive.

    `labelled` names the frame to look for positives in; positives are never lost by
    `keep_best_outcome`, so the frame before it gives the same groups with less work.
    """
    source = df if labelled is None else labelled
    groups = source.filter(F.col(LABEL) == 1).select(*keys).distinct().select(F.struct(*keys).alias("__group"))
    keyed = df.withColumn("__key", F.struct(*keys))
    return keyed.join(groups, F.col("__key") == F.col("__group"), "left_semi").drop("__key")
