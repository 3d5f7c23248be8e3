import math

import pytest
from pyspark.sql import functions as F

from outcome_engine.functions import stats


def first(df):
    return df.first().asDict()


def test_erfc_matches_math(spark):
    df = spark.range(-800, 801).select((F.col("id") / 100.0).alias("x"))
    for r in df.select("x", stats.erfc("x").alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12)


@pytest.mark.parametrize("dof, x, expected", [
    (1, 3.841458820694124, 0.05), (2, 5.991464547107979, 0.05), (3, 7.814727903251179, 0.05),
    (4, 9.487729036781154, 0.05), (7, 14.067140449340169, 0.05), (10, 18.307038053275146, 0.05), (0, 3.0, 1.0)])
def test_chi2_survival_at_table_values(spark, dof, x, expected):
    df = spark.createDataFrame([(x, dof)], "x double, k int")
    assert df.select(stats.chi2_survival("x", "k")).first()[0] == pytest.approx(expected, abs=1e-9)


def test_chi2_survival_literal_dof_and_null(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (None, 2)], "x double, k int")
    one, none = df.select("k", stats.chi2_survival("x", 1).alias("a"), stats.chi2_survival("x", "k").alias("b")).orderBy("k").collect()
    assert one.a == pytest.approx(0.05) and one.b == pytest.approx(0.05)
    assert none.b is None


def test_ztest_by_hand(spark):
    df = spark.createDataFrame([(30, 20, 100, 100)], "a int, b int, n int, m int")
    got = first(stats.with_ztest(df, "a", "b", "n", "m"))
    z = 0.1 / math.sqrt(0.25 * 0.75 * 0.02)
    assert got["z_score"] == pytest.approx(z)
    assert got["z_p_val"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    one = first(stats.with_ztest(df, "a", "b", "n", "m", two_tailed=False))
    assert one["z_p_val"] == pytest.approx(got["z_p_val"] / 2)


@pytest.mark.parametrize("counts", [(0, 1, 5, 5), (1, 0, 5, 5), (1, 1, 0, 5), (1, 1, 5, 0)])
def test_any_zero_gives_zeros(spark, counts):
    df = spark.createDataFrame([counts], "a int, b int, n int, m int")
    got = first(stats.with_gtest(stats.with_ztest(df, "a", "b", "n", "m"), "a", "b", "n", "m"))
    assert (got["z_score"], got["z_p_val"], got["g_stat"], got["g_p_val"]) == (0, 0, 0, 0)


def test_pooled_share_above_one_is_null(spark):
    df = spark.createDataFrame([(9, 8, 4, 5)], "a int, b int, n int, m int")
    got = first(stats.with_ztest(df, "a", "b", "n", "m"))
    assert got["z_score"] is None and got["z_p_val"] is None


def test_gtest_by_hand(spark):
    df = spark.createDataFrame([(30, 20, 100, 100)], "a int, b int, n int, m int")
    expected = 2 * (30 * math.log(30 / 25) + 70 * math.log(70 / 75) + 20 * math.log(20 / 25) + 80 * math.log(80 / 75))
    got = first(stats.with_gtest(df, "a", "b", "n", "m"))
    assert got["g_stat"] == pytest.approx(expected)
    assert got["g_p_val"] == pytest.approx(math.erfc(math.sqrt(expected / 2)))


def test_odds_ratio_by_hand(spark):
    odds, low, high = spark.range(1).select(*stats.odds_ratio(*[F.lit(v) for v in (30, 20, 70, 80)])).first()
    se = math.sqrt(1 / 30 + 1 / 20 + 1 / 70 + 1 / 80)
    assert odds == pytest.approx(30 * 80 / (20 * 70))
    assert low == pytest.approx(math.exp(math.log(odds) - 1.959963984540054 * se))
    assert high == pytest.approx(math.exp(math.log(odds) + 1.959963984540054 * se))
