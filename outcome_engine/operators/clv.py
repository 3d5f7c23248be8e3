"""Customer purchase aggregates and the recency / frequency / monetary summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcome_engine.functions.columns import count_values, ratio, total
from outcome_engine.operators.clean import calendar
from outcome_engine.operators.filters import apply_where
from outcome_engine.operators.prefix import exact_quantiles
from outcome_engine.session import cut_lineage
from outcome_engine.spec import MetricSpec, unique_in_order

# Fixed values: (recency, frequency, monetary) quartile codes of the default segments.
DEFAULT_SEGMENTS = {
    "Premium Customer": ("334", "443", "444", "344", "434", "433", "343", "333"),
    "Repeat Customer": ("244", "234", "232", "332", "143", "233", "243", "242"),
    "Top Spender": ("424", "414", "144", "314", "324", "124", "224", "423", "413", "133", "323", "313", "134"),
    "At Risk Customer": ("422", "223", "212", "122", "222", "132", "322", "312", "412", "123", "214"),
    "Inactive Customer": ("411", "111", "113", "114", "112", "211", "311"),
}
UNKNOWN_SEGMENT = "Unknown"
# Segment names of the rule maps, as (champion, loyal, potential, at risk, dormant).
RULE_SEGMENTS = {
    "retail_banking": ("Wealth Champions", "Premier Clients", "Growth Investors", "At-Risk Clients", "Dormant Accounts"),
    "telco": ("Platinum Subscribers", "Engaged Subscribers", "Potential Upsell Group", "Churn Risk", "Dormant Lines"),
    "e-commerce": ("Champions", "Repeat Buyers", "High-Potential Buyers", "At-Risk Shoppers", "Inactive Shoppers"),
}


def clv(holdings: DataFrame, spec: MetricSpec, as_of) -> DataFrame:
    """Holdings, value and first/last purchase per dimensions, customer, year and quarter.

    `as_of` (a date or timestamp) is explicit: purchases older than `lifespan` years before it drop out.
    """
    bought, value = F.col(spec.purchase_date_col), F.col(spec.monetary_value_col).cast("double")
    start = F.add_months(F.lit(as_of).cast("date"), -12 * spec.lifespan)
    recent = apply_where(holdings, spec.where).filter(bought > start)
    dated = recent.withColumns({n: c for n, c in calendar(spec.purchase_date_col).items() if n in ("Year", "Quarter")})
    dated = dated.withColumn("Year", F.col("Year").cast("string"))
    aggs = [
        count_values(spec.order_id_col).alias("unique_holdings"),
        total(value).alias("lifetime_value"),
        F.min(bought).alias("MinPurchasedDate"),
        F.max(bought).alias("MaxPurchasedDate"),
    ]
    if spec.model != "contractual":
        return dated.groupBy(*spec.keys).agg(*aggs)
    recurring = F.col(spec.recurring_cost_col).cast("double") * F.col(spec.recurring_period_col)
    summed = dated.groupBy(*spec.keys).agg(*aggs, total(recurring).alias("recurring_costs"))
    return summed.withColumn("lifetime_value", F.col("lifetime_value") + F.col("recurring_costs"))


def rfm_features(aggregates: DataFrame, spec: MetricSpec) -> DataFrame:
    """Per customer: frequency, recency, tenure (days) and monetary value."""
    customer = spec.customer_id_col
    keys = unique_in_order(spec.group_by, customer)
    end = aggregates.agg(F.max("MaxPurchasedDate")).scalar()
    summed = aggregates.filter(F.col(customer).isNotNull()).groupBy(*keys).agg(
        F.lit(1).cast("long").alias("customers_count"),
        total("unique_holdings").alias("unique_holdings"),
        F.round(total("lifetime_value"), 2).alias("lifetime_value"),
        F.min("MinPurchasedDate").alias("__first"),
        F.max("MaxPurchasedDate").alias("__last"),
    )
    active = _whole_days("__first", F.col("__last"))
    tenure = _whole_days("__first", end)
    return summed.select(
        *keys, "customers_count", "unique_holdings", "lifetime_value",
        (F.col("unique_holdings") - 1).alias("frequency"),
        (tenure - active).cast("double").alias("recency"),
        tenure.cast("double").alias("tenure"),
        F.when(F.col("unique_holdings") == 1, F.lit(0.0))
        .otherwise(ratio("lifetime_value", "unique_holdings")).alias("monetary_value"),
    )


def _whole_days(start: str, end: Column) -> Column:
    return F.timestamp_diff("DAY", F.col(start).cast("timestamp"), end.cast("timestamp"))


def quartile(value: str, breaks: Column, reverse: bool = False) -> Column:
    """1..4 by the number of breaks below the value; equal values share a quartile."""
    q = F.lit(1)
    for i in range(3):
        q = q + (F.col(value).cast("double") > breaks[i]).cast("int")
    return ((5 - q) if reverse else q).cast("string")


def rfm_quartiles(features: DataFrame) -> DataFrame:
    """Quartiles over the whole frame; recency runs from 4 (most recent) to 1.

    The breaks are exact quantiles, read as one scalar subquery. Three passes read the features (brackets, counts,
    result), so they are written down first.
    """
    features = cut_lineage(features)
    names = ("frequency", "monetary_value", "recency")
    found = exact_quantiles(features, [], names, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    packed = found.select(F.array(*[F.array(*[F.col(f"{n}_{q}") for q in ("q1", "q2", "q3")]) for n in names]))
    breaks = packed.scalar()
    return features.withColumn("__breaks", breaks).withColumns({
        "f_quartile": quartile("frequency", F.col("__breaks")[0]),
        "m_quartile": quartile("monetary_value", F.col("__breaks")[1]),
        "r_quartile": quartile("recency", F.col("__breaks")[2], reverse=True),
    }).drop("__breaks")


def segment(segment_map: str | None = None) -> Column:
    """Segment name from the three quartile columns."""
    r, f, m = (F.col(c).cast("int") for c in ("r_quartile", "f_quartile", "m_quartile"))
    if segment_map in RULE_SEGMENTS:
        champion, loyal, potential, at_risk, dormant = RULE_SEGMENTS[segment_map]
        return (F.when((r <= 2) & (f >= 2) & (m >= 2), at_risk)
                .when((r == 4) & (f == 4) & (m == 4), champion)
                .when((r >= 3) & (f >= 3) & (m >= 2), loyal)
                .when((r >= 3) & (f >= 2) & (m >= 2), potential)
                .otherwise(dormant))
    code = F.concat("r_quartile", "f_quartile", "m_quartile")
    named = reduce(lambda acc, item: acc.when(code.isin(list(item[1])), item[0]),
                   list(DEFAULT_SEGMENTS.items())[1:],
                   F.when(code.isin(list(DEFAULT_SEGMENTS["Premium Customer"])), "Premium Customer"))
    return named.otherwise(UNKNOWN_SEGMENT)


def rfm_score() -> Column:
    quartiles = sum((F.col(c).cast("double") for c in ("r_quartile", "f_quartile", "m_quartile")), F.lit(0.0))
    return F.round(quartiles / 3, 2)


def rfm_summary(aggregates: DataFrame, spec: MetricSpec) -> DataFrame:
    ranked = rfm_quartiles(rfm_features(aggregates, spec))
    return ranked.withColumns({"rfm_segment": segment(spec.segment_map), "rfm_score": rfm_score()})


def segments_by(rfm: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Customers, value and mean scores per segment and further dimensions."""
    return rfm.groupBy(*unique_in_order("rfm_segment", group_by)).agg(
        total("customers_count").alias("customers_count"),
        total("lifetime_value").alias("lifetime_value"),
        total("unique_holdings").alias("unique_holdings"),
        F.avg("monetary_value").alias("monetary_value"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("rfm_score").alias("avg_rfm_score"))
