import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from outcome_engine.operators import conversion, engagement, labels, merge
from outcome_engine.plans import reports, tables
from outcome_engine.spec import MetricSpec, ReportSpec

SPEC = MetricSpec("engagement", ("Channel",), positive=("Clicked",), negative=("Impression", "Pending"))
SCHEMA = ("InteractionID string, ActionID string, Rank int, Outcome string, Channel string, ModelControlGroup string, "
          "SubjectID string, ConversionEventID string, Revenue double")


def events(spark, data):
    full = [(i, "a", 1, o, ch, arm, s, ev, rev) for i, o, ch, arm, s, ev, rev in data]
    return spark.createDataFrame(full, SCHEMA)


def test_best_outcome_keeps_ties_and_null_keys(spark):
    df = events(spark, [("1", "Clicked", "W", "Test", "s", "e", 0.0), ("1", "Impression", "W", "Test", "s", "e", 0.0),
                        ("2", "Impression", "W", "Test", "s", "e", 0.0), ("2", "Pending", "W", "Test", "s", "e", 0.0),
                        (None, "Clicked", "W", "Test", "s", "e", 0.0), (None, "Impression", "W", "Test", "s", "e", 0.0),
                        ("3", "Other", "W", "Test", "s", "e", 0.0), ("4", None, "W", "Test", "s", "e", 0.0)])
    kept = labels.keep_best_outcome(labels.label_outcomes(df, SPEC.positive, SPEC.negative))
    assert sorted((r.InteractionID or "-", r.Outcome) for r in kept.collect()) == [
        ("-", "Clicked"), ("1", "Clicked"), ("2", "Impression"), ("2", "Pending")]


def test_one_key_with_most_rows(spark):
    hot = spark.range(30000).select(
        F.lit("hot").alias("InteractionID"), F.lit("a").alias("ActionID"), F.lit(1).alias("Rank"),
        F.when(F.col("id") % 3 == 0, "Clicked").otherwise("Impression").alias("Outcome"),
        F.lit("W").alias("Channel"), F.lit("Test").alias("ModelControlGroup"))
    got = engagement.engagement(hot, SPEC).first()
    assert (got["Count"], got.Positives, got.Negatives) == (10000, 10000, 0)


def test_hot_key_is_split_by_the_skew_join(spark):
    """The form that keeps rows (for the model metrics) joins: with small thresholds AQE splits the partition of the hot key."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("InteractionID"), F.lit("a").alias("ActionID"),
            F.lit(1).alias("Rank"), F.when(F.col("id") % 9 == 0, "Clicked").otherwise("Impression").alias("Outcome"),
            F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("Channel"), F.lit("Test").alias("ModelControlGroup"))
        kept = labels.keep_best_outcome(labels.label_outcomes(df, SPEC.positive, SPEC.negative))
        made = kept.groupBy("Channel").count()
        whole = sum(r["count"] for r in made.collect())
        plan = made._jdf.queryExecution().executedPlan().toString()
        counted = engagement.engagement(df, SPEC)
        assert sum(r["Count"] for r in counted.collect()) == whole
        cells = counted._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # 20000 hot rows keep their 6667 clicks; the other 40000 keys keep their single row.
    assert whole == 6667 + 40000
    assert "skew=true" in plan
    # the form that counts has no join and one scan: the hot key has shrunk to 50 cells a task before its shuffle
    assert "Join" not in cells and cells.count("Range (") == 1 and "partial_count" in cells


def counts(spark, data):
    return spark.createDataFrame(data, "Channel string, ModelControlGroup string, Count long, Positives long, Negatives long")


def test_engagement_scores_by_hand(spark):
    df = counts(spark, [("W", "Test", 100, 30, 70), ("W", "Control", 50, 10, 40), ("W", "Other", 10, 2, 8)])
    got = reports.engagement_scores(df, ["Channel"]).first()
    p_t, p_c = 32 / 110, 10 / 50
    assert got.Lift == pytest.approx((p_t - p_c) / p_c) and got.CTR == pytest.approx(42 / 160)
    assert got.StdErr == pytest.approx(math.sqrt(42 / 160 * 118 / 160 / 160))
    pooled = 42 / (78 + 40)
    z = (32 / 78 - 10 / 40) / math.sqrt(pooled * (1 - pooled) * (1 / 78 + 1 / 40))
    assert got.Lift_Z_Score == pytest.approx(z)
    textbook = reports.engagement_scores(df, ["Channel"], n_mode="total").first()
    pooled = 42 / 160
    assert textbook.Lift_Z_Score == pytest.approx((p_t - p_c) / math.sqrt(pooled * (1 - pooled) * (1 / 110 + 1 / 50)))


def test_engagement_special_groups(spark):
    df = counts(spark, [("one", "Test", 10, 3, 7), ("inf", "Test", 10, 3, 7), ("inf", "Control", 5, 0, 5),
                        ("gone", "Test", 4, 4, 0), ("null", None, 10, 3, 7), ("null", "Control", 10, 2, 8)])
    got = {r["Channel"]: r for r in rows(reports.engagement_scores(df, ["Channel"]))}
    assert got["one"]["Lift"] == 0 and got["one"]["Lift_Z_Score"] == 0
    assert got["inf"]["Lift"] == 0 and got["inf"]["Lift_P_Val"] == 0
    assert got["null"]["Lift"] == pytest.approx(0.5)
    assert "gone" not in got
    whole = reports.engagement_scores(df).first()
    assert whole["ALL"] == "ALL" and whole["Count"] == 45


def test_conversion_counts_touchpoints_on_all_rows(spark):
    spec = MetricSpec("conversion", ("Channel",), positive=("Conversion",), negative=("NoConversion",))
    df = events(spark, [("1", "Conversion", "W", "Test", "s", "e", 10.0), ("2", "Conversion", "W", "Test", "s", "e", 5.0),
                        ("3", "NoConversion", "W", "Test", "s", "e", 0.0), ("4", "NoConversion", "W", "Test", "t", "e", 0.0),
                        ("5", "NoConversion", "M", "Test", "t", "e", 0.0), ("6", "Conversion", "M", "Test", None, "e", 1.0)])
    got = rows(conversion.conversion(df, spec), "Channel")
    assert [(r["Channel"], r["Count"], r["Revenue"], r["Touchpoints"], r["Positives"], r["Negatives"]) for r in got] == [
        ("M", 2, 1.0, 0, 1, 1), ("W", 4, 15.0, 6, 2, 2)]
    scored = rows(reports.conversion_scores(conversion.conversion(df, spec), ["Channel"]), "Channel")
    assert scored[1]["AvgTouchpoints"] == 3.0 and scored[1]["ConversionRate"] == 0.5
    none = spark.createDataFrame([("W", 3, 0, 3, 0.0, 0)], "Channel string, Count long, Positives long, Negatives long, Revenue double, Touchpoints long")
    assert reports.conversion_scores(none, ["Channel"]).first().AvgTouchpoints is None


def arms(spark, data):
    return spark.createDataFrame(data, "E string, ExperimentGroup string, Count long, Positives long, Negatives long")


EXP = MetricSpec("experiment", positive=("Clicked",), negative=("Impression",))


def test_experiment_two_arms(spark):
    df = arms(spark, [("x", "Test", 100, 30, 70), ("x", "Control", 100, 20, 80)])
    got = reports.experiment_scores(df, EXP, ["E"]).first()
    assert got.chi2_stat == pytest.approx(2 * 25 / 25 + 2 * 25 / 75) and got.chi2_dof == 1
    assert got.z_score == pytest.approx(0.1 / math.sqrt(0.25 * 0.75 * 0.02))
    assert got.chi2_p_val == pytest.approx(got.z_p_val)
    assert got.g_odds_ratio_stat == pytest.approx(30 * 80 / (20 * 70))
    odds = tables.odds_table(reports.experiment_scores(df, EXP, ["E"])).first()
    assert odds.winner == "N/A" and odds.x_plus > odds.x_minus


def test_experiment_three_arms_one_arm_and_zero_cells(spark):
    df = arms(spark, [("three", a, 100, p, 100 - p) for a, p in (("A", 20), ("B", 30), ("C", 40))]
              + [("one", "A", 10, 5, 5), ("zero", "A", 10, 5, 5), ("zero", "B", 5, 0, 5)])
    got = {r["E"]: r for r in rows(reports.experiment_scores(df, EXP, ["E"]))}
    assert got["three"]["chi2_stat"] == pytest.approx(200 / 30 + 200 / 70) and got["three"]["chi2_dof"] == 2
    assert got["three"]["chi2_p_val"] == pytest.approx(math.exp(-got["three"]["chi2_stat"] / 2))
    assert got["three"]["z_score"] == 0 and got["three"]["chi2_odds_ratio_stat"] == 0
    assert got["one"]["chi2_stat"] == 0 and got["one"]["chi2_p_val"] == 1 and got["zero"]["chi2_dof"] == 0


def test_compact_of_union_is_aggregate_of_union(spark):
    df = spark.range(500).select(
        F.col("id").cast("string").alias("InteractionID"), F.lit("a").alias("ActionID"), F.lit(1).alias("Rank"),
        F.when(F.col("id") % 3 == 0, "Clicked").otherwise("Impression").alias("Outcome"),
        F.concat(F.lit("c"), F.col("id") % 4).alias("Channel"),
        F.when(F.col("id") % 5 == 0, "Control").otherwise("Test").alias("ModelControlGroup"))
    a, b = df.filter("InteractionID < '3'"), df.filter("InteractionID >= '3'")
    merged = merge.merge_loads(engagement.engagement(a, SPEC), engagement.engagement(b, SPEC), SPEC)
    assert rows(merged.select(*SPEC.keys, "Count", "Positives", "Negatives")) == rows(
        engagement.engagement(df, SPEC).select(*SPEC.keys, "Count", "Positives", "Negatives"))


def test_routing_and_tables(spark):
    df = counts(spark, [("W", "Test", 100, 30, 70), ("W", "Control", 50, 10, 40), ("M", "Test", 10, 1, 9)])
    report = ReportSpec(SPEC, x="Channel")
    assert [r["Channel"] for r in tables.line(df, report).collect()] == ["M", "W"]
    tree = rows(tables.treemap(df, "engagement", ["Channel"]), "path")
    assert [t["path"] for t in tree] == ["ALL", "ALL/M", "ALL/W"] and tree[0]["Count"] == 160
    cards = rows(tables.cards(df, "engagement", ["Channel"]), "Channel")
    assert cards[1]["delta"] == pytest.approx(40 / 150 - 41 / 160)
    scored = reports.engagement_scores(df, ["Channel"])
    gauge = {r["Channel"]: r["status"] for r in rows(tables.gauge(scored, ["Channel"], "CTR", {"W": 0.4, "M": 0.11}))}
    assert gauge == {"W": "low", "M": "warn"}
    with pytest.raises(ValueError):
        tables.gauge(scored, [], "CTR", {})
    with pytest.raises(ValueError):
        MetricSpec("unknown").family
