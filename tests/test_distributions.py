"""Descriptive statistics, running sums, quantiles, model scores: against plain numpy on small data."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from outcome_engine.functions import sketches
from outcome_engine.operators import descriptive, ml, prefix
from outcome_engine.plans import reports, tables
from outcome_engine.spec import MetricSpec

SPEC = MetricSpec("descriptive", ("g",), columns=("v", "t"), scores=("p25", "p75", "p90", "p95"), use_sketch=False)


def sample(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    data = [("hot" if i % 3 else f"g{i % 5}", float(round(x, 2)), "x") for i, x in enumerate(rng.gamma(2.0, 3.0, n))]
    return spark.createDataFrame(data, "g string, v double, t string"), data


@pytest.mark.parametrize("margin", [prefix.MARGIN, 0.01, 0.2])
def test_exact_quantiles_match_numpy(spark, margin):
    df, data = sample(spark)
    probs = {"a": 0.25, "b": 0.9, "lo": 0.0, "hi": 1.0}
    got = {r["g"]: r for r in prefix.exact_quantiles(df, ["g"], ["v"], probs, margin=margin).collect()}
    for g in {d[0] for d in data}:
        values = [d[1] for d in data if d[0] == g]
        for name, q in (("a", 25), ("b", 90), ("lo", 0), ("hi", 100)):
            assert got[g][f"v_{name}"] == pytest.approx(np.percentile(values, q))


@pytest.mark.parametrize("shape", ["uniform", "ties", "sorted", "wild"])
def test_exact_quantiles_of_large_groups_shuffle_little(spark, shape):
    """Equal to numpy in a group far above the size that is ordered as a whole, and under 5 % of the cells by value."""
    n, rng = 120_000, np.random.default_rng(5)
    v = {"uniform": rng.random(n), "ties": rng.integers(0, 7, n).astype(float), "sorted": np.arange(n) * 1.0,
         "wild": np.exp(rng.normal(0, 30, n)) * rng.choice([-1, 1], n)}[shape]
    small = np.arange(50) * 0.5
    df = spark.createDataFrame([(None, float(x)) for x in v] + [("s", float(x)) for x in small], "g string, v double").repartition(7)
    probs = dict(descriptive.QUANTILES, p999=0.999)
    got = {r["g"]: r for r in prefix.exact_quantiles(df, ["g"], ["v"], probs).collect()}
    for g, values in ((None, v), ("s", small)):
        for name, p in probs.items():
            assert got[g][f"v_{name}"] == pytest.approx(np.quantile(values, p), rel=1e-12)
    brackets = prefix.quantile_brackets(df, ["g"], ["v"], list(probs.values()))
    cells = prefix.bracketed_counts(df, ["g"], ["v"], brackets, len(probs))
    assert cells.count() < 0.05 * n and cells.agg(F.sum("__n")).first()[0] == n + 50
    assert "BroadcastHashJoin" in cells._jdf.queryExecution().executedPlan().toString()


def test_quantiles_with_nan_and_negative_zero(spark):
    """NaN is larger than every number, in groups that are ordered as a whole and in bracketed ones."""
    for n in (9, 30_000):
        df = spark.range(n).selectExpr("if(id % 3 = 0, double('NaN'), if(id % 3 = 1, -0.0d, double('inf'))) AS a")
        got = prefix.exact_quantiles(df, [], ["a"], {"x": 0.1, "y": 0.5, "z": 0.9}).first()
        assert got.a_x == 0 and got.a_y == math.inf and math.isnan(got.a_z)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, a double")
    assert prefix.exact_quantiles(empty, [], ["a"], {"m": 0.5}).collect()[0].a_m is None
    assert prefix.exact_quantiles(empty, ["g"], ["a"], {"m": 0.5}).count() == 0


def test_quantiles_next_to_infinities(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (math.inf,), (math.inf,)], "a double")
    assert prefix.exact_quantiles(df, [], ["a"], {"m": 0.5}).first().a_m == math.inf


def test_quantiles_of_two_columns_with_nulls_and_no_keys(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5), (4.0, 5), (9.0, None)], "a double, b int")
    got = prefix.exact_quantiles(df, [], ["a", "b"], {"m": 0.5}).first()
    assert (got.a_m, got.b_m) == (3.0, 5.0)


@pytest.mark.parametrize("cuts", [None, [], [5.0], [1.0, 2.0, 3.0, 50.0]])
def test_prefix_sums_do_not_depend_on_the_cut_points(spark, cuts):
    df = spark.range(60).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("v"), F.lit(2).alias("m"))
    for r in prefix.prefix_sums(df, ["k"], "v", ["m"], cuts, buckets=4).collect():
        assert r.m_before == 2 * r.v and r.m_total == 40


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 2), (5, 3), (7, 1)], "v int, w int")
    assert {r.v: r["rank"] for r in prefix.average_ranks(df, [], "v", "w").collect()} == {1: 1.5, 5: 4.0, 7: 6.0}


def test_small_groups(spark):
    df = spark.createDataFrame([("one", 5.0, "x"), ("two", 1.0, "x"), ("two", 3.0, None), ("none", None, "x")], "g string, v double, t string")
    got = {r["g"]: r for r in rows(descriptive.descriptive_exact(df, SPEC))}
    assert got["one"]["v_Var"] is None and got["one"]["v_Median"] == 5.0
    assert got["two"]["v_Var"] == 2.0 and got["two"]["t_Count"] == 1 and got["two"]["v_p25"] == 1.5
    assert got["none"]["v_Count"] == 0 and got["none"]["v_Sum"] == 0 and got["none"]["v_Mean"] is None and got["none"]["v_Median"] is None
    assert descriptive.numeric_columns(df, ["v", "t", "absent"]) == ["v"]


def test_pooled_moments_equal_direct_ones(spark):
    df, data = sample(spark)
    fine = descriptive.descriptive_exact(df.withColumn("h", F.col("v").cast("int") % 4), SPEC.but(group_by=("g", "h")))
    pooled = {r["g"]: r for r in rows(descriptive.pooled(fine, SPEC, ["g"]))}
    for g, r in pooled.items():
        values = np.array([d[1] for d in data if d[0] == g])
        assert r["v_Mean"] == pytest.approx(values.mean()) and r["v_Var"] == pytest.approx(values.var(ddof=1))
        assert r["v_Count"] == len(values) and r["v_Max"] == values.max()


def test_sketch_report_is_close_to_exact(spark):
    df, data = sample(spark, 20000)
    spec = SPEC.but(use_sketch=True)
    fine = descriptive.descriptive_sketch(df.withColumn("h", F.col("v").cast("int") % 4), spec.but(group_by=("g", "h")))
    got = {r["g"]: r for r in rows(reports.descriptive_scores(descriptive.compact_descriptive(fine, spec), spec, ["g"]))}
    values = np.sort([d[1] for d in data if d[0] == "hot"])
    for q, name in ((0.5, "Median"), (0.25, "p25"), (0.95, "p95")):
        assert np.searchsorted(values, got["hot"][f"v_{name}"]) / len(values) == pytest.approx(q, abs=0.02)
    q1, q2, q3 = (got["hot"][f"v_{n}"] for n in ("p25", "Median", "p75"))
    assert got["hot"]["v_Skew"] == pytest.approx((q3 + q1 - 2 * q2) / (q3 - q1))
    assert got["hot"]["v_p100"] == values[-1] and got["hot"]["v_Std"] == pytest.approx(values.std(ddof=1))


def test_empty_sketch(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double").groupBy("g").agg(sketches.build("v").alias("s"))
    got = df.select(sketches.size("s").alias("n"), sketches.quantile("s", 0.5).alias("q"), sketches.quantiles("s", [0.1, 0.9]).alias("qs")).first()
    assert (got.n, got.q, list(got.qs)) == (0, 0.0, [0.0, 0.0])
    merged = df.unionByName(spark.createDataFrame([("b", 3.0)], "g string, v double").groupBy("g").agg(sketches.build("v").alias("s")))
    assert merged.agg(sketches.size(sketches.merge("s"))).first()[0] == 1


@pytest.mark.parametrize("value_range", [None, (0.0, 100.0)])
def test_sketch_histogram(spark, value_range):
    df = spark.range(10000).select((F.col("id") / 100.0).alias("v")).agg(sketches.build("v").alias("s"))
    got = sketches.histogram(df, "s", 10, value_range).collect()
    assert len(got) == 10 and sum(r.mass for r in got) == pytest.approx(1.0, abs=0.02)
    assert all(r["mass"] == pytest.approx(0.1, abs=0.02) for r in got)


def test_boxplot_and_funnel(spark):
    scores = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 2.0, 1.0, -9.0, 4.0, 16)],
                                   "g string, v_p25 double, v_Median double, v_p75 double, v_Mean double, v_Std double, v_Min double, v_Max double, v_Count long")
    box = tables.boxplot(scores, "v", ["g"]).first()
    assert (box.lower_fence, box.upper_fence) == (-2.0, 4.0) and box.notch == pytest.approx(1.57 * 2 / 4)
    stored = spark.createDataFrame([("x", "Seen", 5), ("y", "Seen", 2), ("y", "Clicked", 1)], "g string, Outcome string, Outcome_Count long")
    got = {(r.g, r.Stage): r.Count for r in tables.funnel(stored, "Outcome", ["Seen", "Clicked", "Bought"], ["g"]).collect()}
    assert got == {("x", "Seen"): 5, ("x", "Clicked"): 0, ("y", "Seen"): 2, ("y", "Clicked"): 1}
    assert tables.funnel(stored, "Outcome", ["Bought"], ["g"]).count() == 0


# ---- model scores -----------------------------------------------------------------------------------


def scored(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * label, 0.2), 0, 1), 2)
    data = [("hot" if i % 3 else "small", float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))]
    return spark.createDataFrame(data, "g string, Propensity double, Outcome_Binary int"), data


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def average_precision(score, label):
    value, seen = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        up = score >= t
        recall = label[up].sum() / label.sum()
        value += (recall - seen) * label[up].mean()
        seen = recall
    return value


def test_exact_binary_metrics(spark):
    df, data = scored(spark)
    got = {r.g: r for r in ml.exact_binary_metrics(df, ["g"]).collect()}
    flipped = {r.g: r for r in ml.exact_binary_metrics(df.withColumn("Propensity", -F.col("Propensity")), ["g"]).collect()}
    for g in ("hot", "small"):
        s, y = (np.array([d[i] for d in data if d[0] == g]) for i in (1, 2))
        assert got[g].roc_auc == pytest.approx(auc(s, y)) and got[g].average_precision == pytest.approx(average_precision(s, y))
        assert flipped[g].roc_auc == pytest.approx(1 - got[g].roc_auc)


def curve_by_hand(score, label):
    thresholds = [round(i / 100, 4) for i in range(101)]
    tpr = np.array([0, *[(score[label == 1] > t).mean() for t in thresholds][::-1], 1])
    fpr = np.array([0, *[(score[label == 0] > t).mean() for t in thresholds][::-1], 1])
    tp, fp = (label == 1).sum() * tpr, (label == 0).sum() * fpr
    precision = np.maximum.accumulate((tp / (tp + fp + 1e-10))[::-1])[::-1]
    return (np.sum(np.diff(fpr) * (tpr[1:] + tpr[:-1]) / 2), np.sum(np.diff(tpr) * precision[1:]), tpr, fpr)


def test_curves_from_bins_and_from_sketches(spark):
    df, data = scored(spark)
    bins = ml.score_bins(df, ["g"])
    got = {r.g: r for r in ml.curve_scores(ml.shares_from_bins(bins, ["g"]), ["g"]).collect()}
    label = F.col("Outcome_Binary")
    sk = df.groupBy("g").agg(sketches.build(F.when(label == 1, F.col("Propensity"))).alias("p"),
                             sketches.build(F.when(label == 0, F.col("Propensity"))).alias("n"))
    near = {r.g: r for r in ml.curve_scores(ml.shares_from_sketches(sk, ["g"], "p", "n"), ["g"]).collect()}
    for g in ("hot", "small"):
        s, y = (np.array([d[i] for d in data if d[0] == g]) for i in (1, 2))
        area, ap, tpr, fpr = curve_by_hand(s, y)
        assert got[g].roc_auc == pytest.approx(area) and got[g].average_precision == pytest.approx(ap)
        assert np.allclose(got[g].tpr, tpr) and np.allclose(got[g].fpr, fpr)
        assert near[g].roc_auc == pytest.approx(area, abs=0.02) and near[g].average_precision == pytest.approx(ap, abs=0.03)


def test_one_label_only_scores_zero(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.7, 1)], "g string, Propensity double, Outcome_Binary int")
    got = ml.curve_scores(ml.shares_from_bins(ml.score_bins(df, ["g"]), ["g"]), ["g"]).first()
    assert got.roc_auc == 0 and got.average_precision == 0 and list(got.tpr) == [0.0]


def test_bins_at_their_edges(spark):
    edges = [(i / 100,) for i in range(101)] + [(0.07,), (0.29,), (-0.5,), (1.5,), (None,), (1e-12,), (0.1562,)]
    df = spark.createDataFrame(edges, "s double").select("s", ml.threshold_bin("s").alias("b"), ml.calibration_bin("s").alias("c"))
    for r in df.collect():
        if r.s is None:
            assert r.b is None
            continue
        assert r.b == sum(t < r.s for t in ml.THRESHOLDS) and r.c == sum(e < r.s for e in ml.CALIBRATION_EDGES)


def test_calibration(spark):
    df, data = scored(spark)
    bins = ml.score_bins(df, ["g"])
    got = [r for r in ml.calibration(bins, ["g"]).collect() if r.g == "hot"]
    assert len(got) == 26
    for r in got:
        low, high = ml.CALIBRATION_EDGES[r.cal_bin - 1], ml.CALIBRATION_EDGES[r.cal_bin]
        inside = [(d[1], d[2]) for d in data if d[0] == "hot" and (low < d[1] or r.cal_bin == 1) and (d[1] <= high or r.cal_bin == 26)]
        assert r.n == len(inside)
        assert r.calibration_proba == pytest.approx(np.mean([i[0] for i in inside]) if inside else (low + high) / 2)
        assert r.calibration_rate == pytest.approx(np.mean([i[1] for i in inside]) if inside else 0.0)
    label = F.col("Outcome_Binary")
    sk = df.groupBy("g").agg(sketches.build(F.when(label == 1, F.col("Propensity"))).alias("p"),
                             sketches.build(F.when(label == 0, F.col("Propensity"))).alias("n"))
    near = {r.cal_bin: r for r in ml.calibration_from_sketches(sk, ["g"], "p", "n").collect() if r.g == "hot"}
    full = [r for r in got if r.n > 50]
    assert full and all(near[r.cal_bin].calibration_rate == pytest.approx(r.calibration_rate, abs=0.08) for r in full)
    assert all(near[r.cal_bin].calibration_proba == pytest.approx(r.calibration_proba, abs=0.02) for r in full)


def test_scores_of_zero_and_one_are_on_the_curve_and_in_the_calibration(spark):
    data = [("a", s, y) for s, y, n in ((0.0, 0, 6), (0.0, 1, 2), (0.5, 0, 3), (0.5, 1, 3), (1.0, 1, 5), (1.0, 0, 1), (1.2, 1, 1)) for _ in range(n)]
    df = spark.createDataFrame(data, "g string, Propensity double, Outcome_Binary int")
    bins = ml.score_bins(df, ["g"])
    got = ml.curve_scores(ml.shares_from_bins(bins, ["g"]), ["g"]).first()
    exact = ml.exact_binary_metrics(df.withColumn("Propensity", F.least(F.lit(1.0), "Propensity")), ["g"]).first()
    assert (got.tpr[0], got.fpr[0], got.tpr[-1], got.fpr[-1]) == (0, 0, 1, 1)
    assert got.roc_auc == pytest.approx(ml.exact_binary_metrics(df, ["g"]).first().roc_auc)
    assert exact.roc_auc <= got.roc_auc + 1e-9
    made = {r.cal_bin: r.n for r in ml.calibration(bins, ["g"]).collect()}
    assert sum(made.values()) == len(data) and made[1] == 8 and made[26] == 7


def test_personalization_and_novelty(spark):
    rng = np.random.default_rng(5)
    data = [(f"c{rng.integers(0, 40)}" if i % 3 else "hot", f"i{rng.integers(0, 200)}", f"n{rng.integers(0, 6)}") for i in range(900)]
    df = spark.createDataFrame(data, "SubjectID string, InteractionID string, Name string").withColumn("g", F.lit(1))
    names, people = sorted({d[2] for d in data}), sorted({d[0] for d in data})
    matrix = np.array([[sum(d[0] == p and d[2] == n for d in data) for n in names] for p in people], float)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    similar, u = (unit @ unit.T), len(people)
    assert ml.personalization(df, ["g"]).first().personalization == pytest.approx(1 - (similar.sum() - u) / (u * (u - 1)))
    items = matrix.sum(axis=0)
    longest = max(sum(d[1] == i for d in data) for i in {d[1] for d in data})
    info = sum(n * -(math.log2(n / u) + 1e-10) for n in items)
    assert ml.novelty(df, ["g"]).first().novelty == pytest.approx(info / (u * longest))
    both = ml.recommender_scores(df, ["g"]).first()
    assert both["Count"] == 900 and both.novelty == pytest.approx(info / (u * longest))
    assert both.personalization == pytest.approx(1 - (similar.sum() - u) / (u * (u - 1)))
    one = df.filter("SubjectID = 'hot'")
    assert ml.recommender_scores(one, ["g"]).first().personalization == 0.0
    assert ml.personalization(one, ["g"]).first().personalization == 0.0


def test_gain_and_lift_of_a_random_score_is_flat(spark):
    df = spark.range(4000).select((F.floor(F.col("id") / 2) % 100 / 100.0 + 0.005).alias("Propensity"), (F.col("id") % 2).cast("int").alias("Outcome_Binary"))
    bins = ml.score_bins(df, [])
    for r in tables.gain_and_lift(bins).collect():
        assert r.gain == pytest.approx(r.sample_fraction) and (r.lift == pytest.approx(1.0) or r.sample_fraction < 1e-6)
    assert tables.roc_curve(bins).count() == 103 and tables.calibration_curve(bins).count() == 26


def counted_input(df):
    """The same rows, and an accumulator of how many of them were made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    return df.mapInPandas(count, df.schema), made


def test_exact_statistics_make_their_input_once(spark):
    df, made = counted_input(spark.range(300).selectExpr("id % 3 AS g", "CAST(id AS double) AS x"))
    spec = MetricSpec("descriptive", ("g",), columns=("x",), scores=("Median",), use_sketch=False)
    found = {r.g: r.x_Median for r in descriptive.descriptive_exact(df, spec).collect()}
    assert found == {0: 148.5, 1: 149.5, 2: 150.5}
    assert made.value == 300


def test_scored_rows_make_their_input_once(spark):
    data = [(str(i % 40), "a", 1, str(i % 7), f"item{i % 5}", "Clicked" if i % 9 == 0 else "Impression", "web", 0.5) for i in range(200)]
    df, made = counted_input(spark.createDataFrame(data, "InteractionID string, ActionID string, Rank int, SubjectID string, Name string, "
                                                         "Outcome string, Channel string, Propensity double"))
    spec = MetricSpec("model_ml_scores", ("Channel",), positive=("Clicked",), negative=("Impression",))
    once = ml.scored_once(df, spec)
    assert made.value == 200
    direct = ml.scored_rows(spark.createDataFrame(data, df.schema), spec).select(*once.columns)
    assert sorted(once.collect()) == sorted(direct.collect())
