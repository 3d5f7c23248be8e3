"""Interaction, holding and stream views over the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_engine.operators.clean import with_action_id, with_calendar, with_response_time


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem x orders x customer x part as interaction history (times already timestamps)."""
    # Of lineitem goes into the joins only what the columns below need, its flags and suppliers as small numbers. Parts come first,
    # orders with their customers last: the fewer columns of the two are shuffled with lineitem.
    outcome = (F.when(F.col("l_returnflag") == "R", 0)
               .when(F.col("l_returnflag") == "A", 1)
               .when(F.col("l_linestatus") == "F", 2)
               .otherwise(3))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
        (F.col("l_suppkey") % 30).cast("tinyint").alias("l_suppkey"), outcome.cast("tinyint").alias("l_outcome"))
    ordered = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = (lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
              .join(ordered, F.col("l_orderkey") == F.col("o_orderkey")))
    outcome = F.element_at(F.array(*map(F.lit, ("Clicked", "Impression", "Pending", "Conversion"))), F.col("l_outcome").cast("int") + 1)
    selected = joined.select(
        F.col("l_orderkey").cast("string").alias("InteractionID"),
        F.col("o_custkey").cast("string").alias("SubjectID"),
        F.col("l_linenumber").alias("Rank"),
        F.col("p_type").alias("Issue"),
        F.concat(F.lit("G"), (F.col("l_linenumber") % 4).cast("string")).alias("Group"),
        F.concat("p_type", F.lit("-offer")).alias("Name"),
        outcome.alias("Outcome"),
        F.col("o_orderpriority").alias("Channel"),
        F.col("c_mktsegment").alias("CustomerType"),
        F.when(F.col("l_suppkey") % 5 == 0, "Control").otherwise("Test").alias("ModelControlGroup"),
        F.col("p_brand").alias("ConversionEventID"),
        (F.col("l_discount") * 10).alias("Propensity"),
        (F.col("l_tax") * 10).alias("FinalPropensity"),
        F.least(F.lit(1.0), F.col("l_discount") * 5 + F.when(F.col("l_outcome") == 0, 0.3).otherwise(0.0))
        .alias("SkilledPropensity"),
        F.col("l_quantity").alias("Priority"),
        F.when(outcome == "Conversion", F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(F.lit(0.0))
        .alias("Revenue"),
        F.col("p_type").alias("ExperimentName"),
        F.when(F.col("l_suppkey") % 2 == 0, "Control").otherwise("Test").alias("ExperimentGroup"),
        F.when(F.col("l_suppkey") % 3 == 0, "A").when(F.col("l_suppkey") % 3 == 1, "B").otherwise("C")
        .alias("ExperimentGroup3"),
        F.col("o_orderdate").cast("timestamp").alias("DecisionTime"),
        F.col("l_shipdate").cast("timestamp").alias("OutcomeTime"),
    )
    return with_response_time(with_calendar(with_action_id(selected)))


def holdings(spark: SparkSession, folder: str) -> DataFrame:
    """orders x customer as product holdings."""
    joined = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("CustomerID"),
        F.col("o_orderkey").cast("string").alias("HoldingID"),
        F.col("o_orderdate").cast("timestamp").alias("PurchasedDateTime"),
        F.col("o_totalprice").alias("OneTimeCost"),
        F.col("c_mktsegment").alias("ControlGroup"),
        (F.col("o_totalprice") / 100).alias("RecurringCost"),
        (1 + F.col("o_orderkey") % 12).alias("RecurringPeriod"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return event_outcomes(table(spark, folder, "events"))


def event_outcomes(raw: DataFrame) -> DataFrame:
    outcome = (F.when(F.col("event_type") == "view", "Impression")
               .when(F.col("event_type") == "click", "Clicked")
               .when(F.col("event_type") == "purchase", "Conversion"))
    return raw.withColumns({"ts": F.col("ts").cast("timestamp"), "Outcome": outcome})
