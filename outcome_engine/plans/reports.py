"""Second level: scores per report grouping, computed from first-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outcome_engine.functions import sketches, stats
from outcome_engine.functions.columns import join_on_nullable, ratio, safe_sqrt, total
from outcome_engine.operators import clv as clv_ops
from outcome_engine.operators import descriptive as desc_ops
from outcome_engine.operators import ml as ml_ops
from outcome_engine.operators.engagement import sum_counts
from outcome_engine.spec import (ALL, CONTROL, CONTROL_GROUP, PROPENSITY, MetricSpec, ReportSpec, unique_in_order)


def _keys(df: DataFrame, group_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return ml_ops.with_all_key(df, group_by)


def standard_error(rate: str, positives: str = "Positives", negatives: str = "Negatives"):
    share = F.col(rate)
    return safe_sqrt(ratio(share * (1 - share), F.col(positives) + F.col(negatives)))


def engagement_scores(stored: DataFrame, group_by: Sequence[str] = (), n_mode: str = "negatives") -> DataFrame:
    """CTR, standard error, lift of test over control, and its z-test.

    An arm that is missing in a group takes the other arm's numbers. The z-test takes the negatives
    as group sizes; n_mode="total" gives the textbook sizes (positives + negatives).
    """
    df, keys = _keys(stored.filter(F.col("Negatives") > 0), group_by)
    control = F.col(CONTROL_GROUP) == CONTROL
    # A NULL arm is not Control, so it counts as Test.
    is_control = F.coalesce(control, F.lit(False))
    arms = {"c": is_control, "t": ~is_control}
    sums = [total(m).alias(m) for m in ("Count", "Negatives", "Positives")]
    per_arm = [F.sum(F.when(flag, F.col(m))).alias(f"__{arm}_{m}")
               for arm, flag in arms.items() for m in ("Positives", "Negatives")]
    grouped = df.groupBy(*keys).agg(*sums, *per_arm)
    for m in ("Positives", "Negatives"):
        c, t = F.col(f"__c_{m}"), F.col(f"__t_{m}")
        grouped = grouped.withColumns({f"__c_{m}": F.coalesce(c, t), f"__t_{m}": F.coalesce(t, c)})

    def rate(arm: str):
        p, n = F.col(f"__{arm}_Positives"), F.col(f"__{arm}_Negatives")
        return ratio(p, p + n)

    more = {arm: F.col(f"__{arm}_Positives") if n_mode == "total" else F.lit(0) for arm in "ct"}
    scored = grouped.withColumns({
        **{f"__{arm}_rate": rate(arm) for arm in "ct"},
        **{f"__{arm}_size": F.col(f"__{arm}_Negatives") + more[arm] for arm in "ct"},
        "CTR": ratio(F.col("Positives"), F.col("Positives") + F.col("Negatives")),
    })
    scored = scored.withColumns({
        "Lift": F.coalesce(ratio(F.col("__t_rate") - F.col("__c_rate"), F.col("__c_rate")), F.lit(0.0)),
        "StdErr": standard_error("CTR")})
    tested = stats.with_ztest(scored, "__t_Positives", "__c_Positives", "__t_size", "__c_size",
                              "Lift_Z_Score", "Lift_P_Val")
    return tested.select(*keys, "Negatives", "Positives", "Count", "Lift", "CTR", "StdErr", "Lift_Z_Score", "Lift_P_Val")


def conversion_scores(stored: DataFrame, group_by: Sequence[str]) -> DataFrame:
    df, keys = _keys(stored, group_by)
    summed = sum_counts(df, keys, ("Negatives", "Positives", "Count", "Revenue", "Touchpoints"))
    rated = summed.withColumns({
        "ConversionRate": ratio("Positives", F.col("Positives") + F.col("Negatives")),
        "AvgTouchpoints": ratio("Touchpoints", "Positives"),
    })
    return rated.withColumn("StdErr", standard_error("ConversionRate"))


def experiment_scores(stored: DataFrame, spec: MetricSpec, group_by: Sequence[str]) -> DataFrame:
    """Chi-square, G, z and odds ratio per group. Arm 1 is the last arm name, arm 2 the one before.

    Any number of arms: expected counts come from a window over the arm rows of a group, the
    statistics are plain sums over those rows.
    """
    keys = unique_in_order(group_by)
    if not keys:
        return stored
    arm = spec.experiment_group
    arms = sum_counts(stored, unique_in_order(keys, arm)).filter((F.col("Positives") > 0) & (F.col("Negatives") > 0))
    group = Window.partitionBy(*keys)
    p, n = F.col("Positives").cast("double"), F.col("Negatives").cast("double")
    arms = arms.withColumns({"__P": F.sum(p).over(group), "__N": F.sum(n).over(group)})
    size, everyone = p + n, F.col("__P") + F.col("__N")
    expected = {"p": ratio(size * F.col("__P"), everyone), "n": ratio(size * F.col("__N"), everyone)}
    row = F.struct("Positives", "Negatives", "Count")
    order = F.struct(F.col(arm).isNotNull(), F.col(arm))
    grouped = arms.groupBy(*keys).agg(
        F.sum(stats.chi2_term(p, expected["p"]) + stats.chi2_term(n, expected["n"])).alias("chi2_stat"),
        F.sum(stats.g_term(p, expected["p"]) + stats.g_term(n, expected["n"])).alias("g_stat"),
        (F.count("*") - 1).alias("__dof"),
        F.max_by(row, order).alias("__1"), F.min_by(row, order).alias("__2"),
        *[total(m).alias(m) for m in ("Count", "Positives", "Negatives")])
    two = F.col("__dof") == 1

    def only_two(value):
        return F.when(two, value).otherwise(F.lit(0.0))

    first = {f"__{i}_{m}": F.col(f"__{i}.{m}") for i in "12" for m in ("Positives", "Negatives", "Count")}
    odds = stats.odds_ratio("__1_Positives", "__2_Positives", "__1_Negatives", "__2_Negatives")
    names = ("odds_ratio_stat", "odds_ratio_ci_low", "odds_ratio_ci_high")
    scored = grouped.withColumns(first).withColumns({n: only_two(v) for n, v in zip(names, odds)})
    scored = stats.with_ztest(scored, "__1_Positives", "__2_Positives", "__1_Count", "__2_Count")
    tests = []
    for test in ("chi2", "g"):
        tests += [F.col(f"{test}_stat"), F.col("__dof").alias(f"{test}_dof"),
                  stats.chi2_survival(f"{test}_stat", "__dof").alias(f"{test}_p_val")]
        tests += [F.col(n).alias(f"{test}_{n}") for n in names]
    return scored.select(*keys, *tests, only_two(F.col("z_score")).alias("z_score"),
                         only_two(F.col("z_p_val")).alias("z_p_val"), "Count", "Positives", "Negatives")


CURVES = ("tpr", "fpr", "precision", "recall")
CALIBRATION = ("calibration_bin", "calibration_proba", "calibration_rate")


def model_scores_from_bins(stored: DataFrame, bins: DataFrame, group_by: Sequence[str] = (),
                           drop_curves: bool = True) -> DataFrame:
    """Weighted personalization and novelty with AUC and AP from exact score bins."""
    base, keys = _keys(stored, group_by)
    marked_bins, _ = _keys(bins, group_by)
    means = ml_ops.regroup_model_scores(base, keys, MetricSpec("model_ml_scores"))
    means = means.select(*keys, "personalization", "novelty", "Count")
    curves = ml_ops.curve_scores(ml_ops.shares_from_bins(marked_bins, keys), keys)
    joined = join_on_nullable(means, curves, keys, "left")
    if drop_curves:
        return joined.drop(*CURVES)
    points = ml_ops.calibration(marked_bins, keys)
    lists = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cal_bin", *CALIBRATION))).alias("__c"))
    with_lists = join_on_nullable(joined, lists, keys, "left")
    return with_lists.select(*joined.columns, *[F.col(f"__c.{c}").alias(c) for c in CALIBRATION])


def _sketch_pair(prop: str) -> tuple[str, str]:
    middle = "" if prop == PROPENSITY else "final_"
    return f"sketch_{middle}positives", f"sketch_{middle}negatives"


def model_scores_from_sketches(stored: DataFrame, group_by: Sequence[str] = (), prop: str = PROPENSITY,
                               drop_curves: bool = True) -> DataFrame:
    df, keys = _keys(stored, group_by)
    merged = ml_ops.regroup_model_scores(df, keys, MetricSpec("model_ml_scores"))
    positives, negatives = _sketch_pair(prop)
    curves = ml_ops.curve_scores(ml_ops.shares_from_sketches(merged, keys, positives, negatives), keys)
    out = join_on_nullable(merged.select(*keys, "personalization", "novelty", "Count"), curves, keys, "left")
    return out.drop(*CURVES) if drop_curves else out


def model_scores_weighted(stored: DataFrame, spec: MetricSpec, group_by: Sequence[str] = ()) -> DataFrame:
    """Count-weighted means of scores that were exact per fine group."""
    df, keys = _keys(stored, group_by)
    return ml_ops.regroup_model_scores(df, keys, spec.but(use_sketch=False))


def descriptive_scores(stored: DataFrame, spec: MetricSpec, group_by: Sequence[str]) -> DataFrame:
    df, keys = _keys(stored, group_by)
    numbers = desc_ops.summarised_columns(df, spec.columns)
    if spec.use_sketch:
        out = desc_ops.pooled(df, spec, keys, desc_ops.merged_sketches(df, spec))
        out = desc_ops.with_sketch_quantiles(out, numbers)
    else:
        out = desc_ops.pooled(df, spec, keys, desc_ops.averaged_quantiles(df, spec))
    return desc_ops.with_deviation(out, numbers)


def clv_scores(stored: DataFrame, spec: MetricSpec) -> DataFrame:
    return clv_ops.rfm_summary(stored, spec)


def report_scores(stored: DataFrame, report: ReportSpec) -> DataFrame:
    """Route a report to the calculator of its metric family."""
    spec, keys = report.metric, report.group_by
    family = spec.family
    if family == "engagement":
        return engagement_scores(stored, keys)
    if family == "conversion":
        return conversion_scores(stored, keys)
    if family == "experiment":
        return experiment_scores(stored, spec, unique_in_order(keys, report.facet_row, report.facet_column))
    if family == "model_ml_scores":
        if spec.use_sketch:
            return model_scores_from_sketches(stored, keys, report.score_column)
        return model_scores_weighted(stored, spec, keys)
    if family == "descriptive":
        return descriptive_scores(stored, spec, keys)
    return clv_scores(stored, spec)


def sketch_histogram(stored: DataFrame, spec: MetricSpec, column: str, group_by: Sequence[str],
                     bins: int = 100, value_range=None) -> DataFrame:
    df, keys = _keys(stored, group_by)
    merged = desc_ops.merge_sketches_by(df, spec, keys).select(*keys, f"{column}{desc_ops.SKETCH}")
    return sketches.histogram(merged, f"{column}{desc_ops.SKETCH}", bins, value_range)
