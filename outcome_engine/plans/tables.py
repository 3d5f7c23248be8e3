"""Tables behind the report charts: lines, heat maps, trees, gauges, cards, curves, funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcome_engine.functions.columns import ratio, total
from outcome_engine.operators import ml as ml_ops
from outcome_engine.operators.engagement import sum_counts
from outcome_engine.plans import reports
from outcome_engine.spec import ALL, MetricSpec, ReportSpec, unique_in_order

RATE_OF = {"engagement": "CTR", "conversion": "ConversionRate"}


def line(stored: DataFrame, report: ReportSpec) -> DataFrame:
    """Scores by x, facets and colour, in the order of x."""
    keys = report.dimensions
    return reports.report_scores(stored, report.but(group_by=tuple(keys))).orderBy(*keys)


def polar(stored: DataFrame, report: ReportSpec, theta: str) -> DataFrame:
    keys = unique_in_order(report.group_by, theta, report.color)
    return reports.report_scores(stored, report.but(group_by=tuple(keys)))


def heatmap(scores: DataFrame, y: str, x: str, score: str, x_values: Sequence | None = None) -> DataFrame:
    """y by x pivot of a score, 0 where there is no cell."""
    pivoted = scores.groupBy(y).pivot(x, list(x_values) if x_values else None).agg(F.first(score))
    return pivoted.fillna(0)


def treemap(stored: DataFrame, family: str, dims: Sequence[str]) -> DataFrame:
    """Every level from ALL down to the last dimension; the rate is recomputed from the summed counts."""
    rate = RATE_OF[family]
    kept = stored.filter(F.col("Negatives") > 0) if family == "engagement" else stored
    levels = kept.rollup(*dims).agg(
        *[total(m).alias(m) for m in ("Count", "Positives", "Negatives")], F.grouping_id().alias("__g"))
    depth = F.lit(len(dims)) - F.bit_count(F.col("__g"))
    named = levels.withColumn("level", depth.cast("int"))
    path = F.concat_ws("/", F.lit(ALL), *[
        F.when(F.col("level") > i, F.coalesce(F.col(d).cast("string"), F.lit("(none)"))) for i, d in enumerate(dims)])
    scored = named.withColumn(rate, ratio("Positives", F.col("Positives") + F.col("Negatives")))
    return scored.select(path.alias("path"), "level", *dims, "Count", "Positives", "Negatives", rate,
                         reports.standard_error(rate).alias("StdErr"))


def weighted_treemap(stored: DataFrame, spec: MetricSpec, dims: Sequence[str]) -> DataFrame:
    """Tree of count-weighted model scores (personalization, novelty or the configured ones)."""
    scores = ("personalization", "novelty") if spec.use_sketch else spec.scores
    levels = stored.filter(F.col("Count") > 0).rollup(*dims).agg(
        *[ratio(F.sum(F.col(s) * F.col("Count")), F.sum(F.when(F.col(s).isNotNull(), F.col("Count")))).alias(s)
          for s in scores], total("Count").alias("Count"), F.grouping_id().alias("__g"))
    return levels.withColumn("level", (F.lit(len(dims)) - F.bit_count("__g")).cast("int")).drop("__g")


def scatter(scores: DataFrame, x: str, y: str, size: str, dims: Sequence[str]) -> DataFrame:
    """Axis measures per point, with the ranges of both axes on each row."""
    bounds = scores.agg(F.struct(F.min(x).alias("x_min"), F.max(x).alias("x_max"),
                                 F.min(y).alias("y_min"), F.max(y).alias("y_max"))).scalar()
    return scores.select(*dims, x, y, size, bounds.alias("__b")).select(*dims, x, y, size, "__b.*")


def gauge(scores: DataFrame, group_by: Sequence[str], value: str, reference: Mapping[str, float]) -> DataFrame:
    """Compare a score with a reference per group: `low` below 0.75 of it, `warn` below it, else `ok`."""
    if not 1 <= len(group_by) <= 2:
        raise ValueError("a gauge takes one or two grouping columns")
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in group_by])
    target = reduce(lambda acc, kv: F.when(key == kv[0], F.lit(float(kv[1]))).otherwise(acc),
                    reference.items(), F.lit(None).cast("double"))
    out = scores.withColumns({"key": key, "reference": target})
    v, ref = F.col(value), F.col("reference")
    status = (F.when(ref.isNull() | (ref == 0), "none").when(v < 0.75 * ref, "low")
              .when(v < ref, "warn").otherwise("ok"))
    top = F.max(v).over(Window.partitionBy(group_by[0])) * 1.1
    return out.select(*group_by, "key", value, "reference", (v - ref).alias("delta"),
                      status.alias("status"), top.alias("axis_max"))


def cards(stored: DataFrame, family: str, group_by: Sequence[str]) -> DataFrame:
    """Rate per group and its distance to the overall rate. How fine the groups are is the caller's choice alone."""
    rate = RATE_OF[family]
    keys = list(group_by)
    grouped = sum_counts(stored, keys, ("Negatives", "Positives"))
    overall = stored.agg(ratio(F.sum("Positives"), F.sum("Positives") + F.sum("Negatives"))).scalar()
    rated = grouped.withColumn(rate, ratio("Positives", F.col("Positives") + F.col("Negatives")))
    return rated.select(*keys, "Positives", "Negatives", rate, (F.col(rate) - overall).alias("delta"))


# ---- key figures: an overall row (Month = ALL) followed by the months ------------------------


def _overall_and_monthly(overall: DataFrame, monthly: DataFrame) -> DataFrame:
    return overall.withColumnRenamed(ALL, "Month").unionByName(monthly)


def kpi_engagement(stored: DataFrame) -> DataFrame:
    return _overall_and_monthly(reports.engagement_scores(stored), reports.engagement_scores(stored, ["Month"])).select(
        "Month", "CTR", "Lift", "Lift_P_Val")


def kpi_conversion(stored: DataFrame) -> DataFrame:
    both = _overall_and_monthly(reports.conversion_scores(stored, []), reports.conversion_scores(stored, ["Month"]))
    return both.select("Month", "ConversionRate", "Revenue")


def kpi_touchpoints(stored: DataFrame) -> DataFrame:
    both = _overall_and_monthly(reports.conversion_scores(stored, []), reports.conversion_scores(stored, ["Month"]))
    return both.select("Month", "Positives", "AvgTouchpoints")


def kpi_model(stored: DataFrame, bins: DataFrame) -> DataFrame:
    both = _overall_and_monthly(reports.model_scores_from_bins(stored, bins),
                                reports.model_scores_from_bins(stored, bins, ["Month"]))
    return both.select("Month", "roc_auc", "average_precision", "personalization", "novelty")


# ---- distributions ----------------------------------------------------------------------------


def boxplot(scores: DataFrame, column: str, group_by: Sequence[str]) -> DataFrame:
    q1, q2, q3 = (F.col(f"{column}_{s}") for s in ("p25", "Median", "p75"))
    spread = q3 - q1
    return scores.select(
        *group_by, q1.alias("q1"), q2.alias("median"), q3.alias("q3"), F.col(f"{column}_Mean").alias("mean"),
        F.col(f"{column}_Std").alias("sd"),
        F.greatest(F.col(f"{column}_Min").cast("double"), q1 - 1.5 * spread).alias("lower_fence"),
        F.least(F.col(f"{column}_Max").cast("double"), q3 + 1.5 * spread).alias("upper_fence"),
        ratio(1.57 * spread, F.sqrt(F.col(f"{column}_Count").cast("double"))).alias("notch"))


def funnel(stored: DataFrame, column: str, stages: Sequence[str], group_by: Sequence[str]) -> DataFrame:
    """Count per group and stage, 0 for a missing cell; stages absent everywhere are dropped."""
    shown = list(stages)
    counted = stored.filter(F.col(column).isin(shown))
    pivoted = counted.groupBy(*group_by).pivot(column, shown).agg(F.sum(f"{column}_Count")).fillna(0)
    present = counted.select(F.col(column).alias("Stage")).distinct()  # no more rows than stages
    return pivoted.unpivot(list(group_by), shown, "Stage", "Count").join(F.broadcast(present), "Stage", "left_semi").select(
        *group_by, "Stage", "Count")


# ---- model curves -----------------------------------------------------------------------------


def _curves(bins: DataFrame, group_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    df, keys = ml_ops.with_all_key(bins, group_by)
    return ml_ops.curve_scores(ml_ops.shares_from_bins(df, keys), keys), keys


def roc_curve(bins: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    scored, keys = _curves(bins, group_by)
    return scored.select(*keys, F.posexplode(F.arrays_zip("fpr", "tpr")).alias("point", "__p")).select(
        *keys, "point", "__p.fpr", "__p.tpr")


def precision_recall_curve(bins: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    scored, keys = _curves(bins, group_by)
    return scored.select(*keys, F.posexplode(F.arrays_zip("recall", "precision")).alias("point", "__p")).select(
        *keys, "point", "__p.recall", "__p.precision")


def calibration_curve(bins: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    df, keys = ml_ops.with_all_key(bins, group_by)
    return ml_ops.calibration(df, keys)


def gain_and_lift(bins: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Share of the sample above a threshold, gain (tpr) and lift; lift is 0 for tiny shares."""
    scored, keys = _curves(bins, group_by)
    points = scored.select(*keys, "pos_fraction", F.posexplode(F.arrays_zip("fpr", "tpr")).alias("point", "__p"))
    share = F.col("pos_fraction") * F.col("__p.tpr") + (1 - F.col("pos_fraction")) * F.col("__p.fpr")
    placed = points.select(*keys, "point", share.alias("sample_fraction"), F.col("__p.tpr").alias("gain"))
    return placed.withColumn("lift", F.when(F.col("sample_fraction") > 1e-6, ratio("gain", "sample_fraction"))
                             .otherwise(F.lit(0.0)))


# ---- experiments --------------------------------------------------------------------------------


def experiment_bars(scores: DataFrame, x: str, facets: Sequence[str] = ()) -> DataFrame:
    return scores.dropna().orderBy(*[F.col(c).desc() for c in unique_in_order(facets, x)])


def _winner(high: Column, low: Column) -> Column:
    return (F.when((high < 1) & (low < 1), "Control").when((high > 1) & (low > 1), "Test").otherwise("N/A"))


def odds_table(scores: DataFrame, test: str = "g", facets: Sequence[str] = ()) -> DataFrame:
    """Odds ratio with distances to the interval ends, and the arm the interval speaks for."""
    odds, low, high = (F.col(f"{test}_odds_ratio_{s}") for s in ("stat", "ci_low", "ci_high"))
    out = scores.withColumns({"x_plus": high - odds, "x_minus": odds - low, "winner": _winner(high, low)})
    return out.dropna().orderBy(*[F.col(c) for c in unique_in_order(facets, f"{test}_odds_ratio_stat")])
