import pytest
from conftest import rows
from pyspark.sql import functions as F

from outcome_engine.operators import clean, filters
from outcome_engine.spec import unique_in_order


def test_canonical_names():
    assert clean.canonical_names(["pyName", "Name", "pxUrl", "channel"]) == ["PyName", "Name", "Url", "Channel"]
    with pytest.raises(ValueError):
        clean.canonical_names(["pyName", "pxName"])


def test_unique_in_order():
    assert unique_in_order(["b", "a"], ["a", "c"], "b", None) == ["b", "a", "c"]


def test_technical_columns_go(spark):
    assert len(clean.TECHNICAL_COLUMNS) == 27
    df = spark.createDataFrame([(1, 2, 3)], "pxFactID int, WorkID int, Keep int")
    assert clean.drop_technical(df).columns == ["Keep"]


def test_defaults(spark):
    df = spark.createDataFrame([(None, 1.0), ("x", None)], "A string, B double")
    got = rows(clean.with_defaults(df, {"A": "N/A", "B": "2.5", "C": "7", "D": "text", " ": "skip"}))
    assert got == [{"A": "N/A", "B": 1.0, "C": 7.0, "D": "text"}, {"A": "x", "B": 2.5, "C": 7.0, "D": "text"}]
    held = clean.with_defaults(df, {"C": "7"}, numeric=False)
    assert held.first()["C"] == "7"
    parsed = clean.with_defaults(df, {"C": "true", "D": "12"}, parse=True).first()
    assert parsed["C"] is True and parsed["D"] == 12


def test_time_parsing(spark):
    df = spark.createDataFrame([("20240710T145658.123 GMT",)], "t string")
    assert df.select(clean.parse_time("t").cast("string")).first()[0] == "2024-07-10 14:56:58.123"
    bad = spark.createDataFrame([("yesterday",)], "t string")
    assert bad.select(clean.parse_time("t", lenient=True)).first()[0] is None
    with pytest.raises(Exception):
        bad.select(clean.parse_time("t")).collect()


def raw(spark):
    t = "20240710T145658.123 GMT"
    later = "20240710T145700.000 GMT"
    data = [("1", "I", "G", "N", 1, "Clicked", t, later, "a"), ("1", "I", "G", "N", 1, "Clicked", t, later, "b"),
            ("1", "I", "G", "N", 1, "Impression", t, t, "c"), ("2", None, "G", "N", 1, "Clicked", t, t, "d")]
    return spark.createDataFrame(data, "pxInteractionID string, pyIssue string, pyGroup string, pyName string, "
                                       "pxRank int, pyOutcome string, pxDecisionTime string, pxOutcomeTime string, IPAddress string")


def test_clean_interactions(spark):
    config = clean.CleaningConfig({"Channel": "Web"}, "Rank = 1", {"Upper": "upper(Outcome)"})
    got = rows(clean.clean_interactions(raw(spark), config), "InteractionID", "Outcome")
    assert [(r["InteractionID"], r["Outcome"], r["ActionID"], r["ResponseTime"]) for r in got] == [
        ("1", "Clicked", "I/G/N", 1), ("1", "Impression", "I/G/N", 0), ("2", "Clicked", None, 0)]
    assert got[0]["Quarter"] == "2024_Q3" and got[0]["Month"] == "2024-07" and got[0]["Year"] == 2024
    assert got[0]["Channel"] == "Web" and got[0]["Upper"] == "CLICKED" and "IPAddress" not in got[0]


def test_dedup_keeps_the_smallest_row_whatever_the_order(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 9 > 0, "hot").otherwise("k").alias("K"),
                                   (F.col("id") % 97).alias("v"), F.col("id").alias("w"))
    for n in (1, 7):
        kept = clean.dedup_events(df.repartition(n), ["K"])
        assert sorted(kept.collect()) == [("hot", 0, 97), ("k", 0, 0)]
        assert kept._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_rules(spark):
    df = spark.createDataFrame([("web", 1), ("mobile", 2), (None, 3)], "c string, n int")

    def kept(*rules):
        out = filters.filter_by_rules(df, [dict(zip(("Field", "Operator", "Value"), r)) for r in rules])
        return sorted(r.n for r in out.collect())

    assert kept(("n", "==", "2")) == [2] and kept(("n", "!=", 2)) == [1, 3] and kept(("n", ">", "1")) == [2, 3]
    assert kept(("n", ">=", "2"), ("c", "is not null", "")) == [2] and kept(("n", "<", 2)) == [1]
    assert kept(("n", "<=", 2)) == [1, 2] and kept(("c", "contains", "ob")) == [2]
    assert kept(("c", "starts with", "w")) == [1] and kept(("n", "in", "1, 3")) == [1, 3]
    assert kept(("n", "not in", "1,3")) == [2] and kept(("c", "is null", "")) == [3] and kept() == [1, 2, 3]
    off = [{"Field": "n", "Operator": "==", "Value": 1, "Enabled": False}]
    assert filters.filter_by_rules(df, off).count() == 3


def test_interactive_and_dimension_filters(spark):
    df = spark.createDataFrame([("Web", 1.0), ("Mobile", 2.0), ("Email", 3.0)], "c string, n double")
    assert filters.filter_interactive(df, ranges={"n": (1.5, 3)}).count() == 2
    assert filters.filter_interactive(df, patterns={"c": "^(?!web)"}, case=False).count() == 2
    assert filters.filter_dimensions(df, {"c": ["Web"], "n": [], "absent": [1]}).count() == 1
    assert filters.apply_where(df, "  ").count() == 3
