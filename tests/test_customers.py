import itertools

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from outcome_engine.functions.special import hyp2f1, lgamma
from outcome_engine.operators import clv
from outcome_engine.functions import jets, special
from outcome_engine.plans import customers, purchase_models
from outcome_engine.spec import MetricSpec

SPEC = MetricSpec("clv", customer_id_col="C", order_id_col="H", monetary_value_col="V", purchase_date_col="D")


def holdings(spark):
    data = [("a", "1", 10.0, "2020-01-01"), ("a", "2", 30.0, "2020-03-01"), ("a", "2", 5.0, "2020-03-02"), ("a", None, 1.0, "2021-01-01"),
            ("b", "3", 7.0, "2020-12-31"), (None, "4", 9.0, "2020-01-01"), ("old", "5", 1.0, "1990-01-01")]
    return spark.createDataFrame(data, "C string, H string, V double, D string").withColumn("D", F.to_timestamp("D"))


def test_purchase_aggregates(spark):
    got = rows(clv.clv(holdings(spark), SPEC.but(lifespan=9), "2021-06-01"), "C", "Quarter")
    assert [(r["C"], r["Quarter"], r["unique_holdings"], r["lifetime_value"]) for r in got] == [
        (None, "2020_Q1", 1, 9.0), ("a", "2020_Q1", 2, 45.0), ("a", "2021_Q1", 1, 1.0), ("b", "2020_Q4", 1, 7.0)]
    rich = holdings(spark).withColumns({"RecurringCost": F.lit(2.0), "RecurringPeriod": F.lit(3)})
    full = rows(clv.clv(rich, SPEC.but(lifespan=9, model="contractual"), "2021-06-01"), "C", "Quarter")
    assert full[1]["recurring_costs"] == 18.0 and full[1]["lifetime_value"] == 63.0


def test_rfm_features(spark):
    got = rows(clv.rfm_features(clv.clv(holdings(spark), SPEC.but(lifespan=9), "2021-06-01"), SPEC), "C")
    a, b = got
    assert (a["frequency"], a["tenure"], a["recency"]) == (2, 366.0, 0.0) and a["monetary_value"] == pytest.approx(46 / 3)
    assert (b["frequency"], b["tenure"], b["recency"], b["monetary_value"]) == (0, 1.0, 1.0, 0.0)


def test_quartiles_share_equal_values(spark):
    """70 of 100 frequencies are equal, so the first two breaks coincide."""
    data = [(f"c{i}", 1 if i < 70 else i, float(i), float(i % 10)) for i in range(100)]
    df = spark.createDataFrame(data, "C string, frequency long, monetary_value double, recency double")
    got = clv.rfm_quartiles(df).collect()
    f = [1 if i < 70 else i for i in range(100)]
    breaks = np.percentile(f, [25, 50, 75])
    for r in got:
        assert r.f_quartile == str(1 + sum(r.frequency > b for b in breaks))
    assert {r.f_quartile for r in got if r.frequency == 1} == {"1"}
    assert {r.r_quartile for r in got if r.recency == 0} == {"4"} and {r.r_quartile for r in got if r.recency == 9} == {"1"}


def test_segments_of_all_codes(spark):
    codes = list(itertools.product("1234", repeat=3))
    df = spark.createDataFrame(codes, "r_quartile string, f_quartile string, m_quartile string")
    named = {"".join(r[:3]): r for r in df.select("*", clv.segment().alias("d"), clv.segment("telco").alias("t"), clv.rfm_score().alias("s")).collect()}
    assert sum(r.d == "Unknown" for r in named.values()) == 17
    assert named["444"].d == "Premium Customer" and named["111"].d == "Inactive Customer"
    for code, r in named.items():
        x, y, z = map(int, code)
        if x <= 2 and y >= 2 and z >= 2:
            expected = "Churn Risk"
        elif code == "444":
            expected = "Platinum Subscribers"
        elif y >= 3 and z >= 2:
            expected = "Engaged Subscribers" if x >= 3 else "Dormant Lines"
        else:
            expected = "Potential Upsell Group" if x >= 3 and y >= 2 and z >= 2 else "Dormant Lines"
        assert r.t == expected and r.s == pytest.approx(round((x + y + z) / 3, 2))


def points(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, n)
    y = np.round(x + rng.normal(0, 5, n))
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(x, y)], "g string, x int, y double")
    return df, x, y


def ranks(v):
    return np.array([np.mean(np.flatnonzero(np.sort(v) == a)) + 1 for a in v])


@pytest.mark.parametrize("facet", [None, "g"])
def test_correlations(spark, facet):
    df, x, y = points(spark)

    def value(method):
        return customers.correlation(df, "x", "y", method, facet).first().correlation

    assert value("pearson") == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert value("spearman") == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    tau = np.sum(sx * sy) / np.sqrt(np.sum(sx != 0) * np.sum(sy != 0))
    assert value("kendall") == pytest.approx(tau)


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "x int, y double")
    for method in ("pearson", "spearman", "kendall"):
        assert customers.correlation(df, "x", "y", method).first().correlation is None


def test_histogram_forms(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("w"))
    assert [r.value for r in customers.histogram(df, "x", 4).orderBy("bin").collect()] == [25, 25, 25, 25]
    assert [r.value for r in customers.histogram(df, "x", 4, norm="percent", cumulative=True).orderBy("bin").collect()] == [25, 50, 75, 100]
    assert sum(r.value for r in customers.histogram(df, "x", 4, "w", "sum").collect()) == 200
    dense = customers.histogram(df, "x", 4, norm="probability density").collect()
    assert sum(r.value * (r.right - r.left) for r in dense) == pytest.approx(1.0)
    one = customers.histogram(df.filter("x = 5"), "x", 4).collect()
    assert [(r.bin, r.value) for r in one] == [(0, 1.0)]


def test_density_and_sample(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("C"), (F.col("id") % 7).cast("double").alias("recency"),
                                (F.col("id") % 5).alias("frequency"), F.lit(1.0).alias("tenure"), F.lit(3.0).alias("m"))
    got = customers.density(df, "m", "sum", 7, 5).collect()
    assert sum(r.n for r in got) == 50 and sum(r.value for r in got) == 150
    a, b = (customers.exposure_sample(df.repartition(n), "C", 10).collect() for n in (1, 5))
    assert len(a) == 10 and sorted(r.C for r in a) == sorted(r.C for r in b)


def test_yearly_value_needs_three_years(spark):
    agg = spark.createDataFrame([("a", "2019", 10.0), ("a", "2020", 20.0), ("b", "2020", 20.0), ("a", "2021", 30.0)], "C string, Year string, lifetime_value double")
    got = rows(customers.yearly_value(agg, SPEC), "Year")
    assert [(r["Year"], r["average_value"], r["yoy"]) for r in got] == [("2019", 10.0, None), ("2020", 20.0, 1.0), ("2021", 30.0, 0.5)]
    assert customers.yearly_value(agg.filter("Year > '2019'"), SPEC).count() == 0


# ---- purchase models ------------------------------------------------------------------------------------


def simulated(n=4000, seed=11, r=1.2, alpha=20.0, a=0.8, b=2.5):
    """BG/NBD customers: purchase rate gamma, dropout after each purchase beta."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(n):
        rate, drop, age = rng.gamma(r, 1 / alpha), rng.beta(a, b), rng.integers(60, 200)
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / rate)
            if t > age:
                break
            x, last = x + 1, t
            if rng.random() < drop:
                break
        data.append((x, round(last), int(age)))
    return data


def test_special_functions():
    import math

    x = np.array([0.01, 0.5, 3.3, 12.0, 400.0])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert special.digamma(0.25) == pytest.approx(-0.5772156649015329 - math.pi / 2 - 3 * math.log(2), abs=1e-12)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-13)
    assert hyp2f1(1, 1, 2, 0.5) == pytest.approx(2 * math.log(2))
    assert hyp2f1(0.5, 1.0, 1.5, 0.81) == pytest.approx(math.atanh(0.9) / 0.9)


def test_fit_is_an_optimum_and_matches_numpy(spark):
    data = simulated(1500)
    df = spark.createDataFrame([(x, float(t), float(age)) for x, t, age in data], "frequency long, recency double, tenure double")
    fitted = purchase_models.fit_purchases(df, "bgnbd")
    kept = np.array([d for d in data if d[0] > 0], float)
    scale = 10.0 / kept[:, 2].max()

    def nll(p):
        return -purchase_models.bgnbd_loglik(p, kept[:, 0], kept[:, 1] * scale, kept[:, 2] * scale).mean() + 0.001 * np.sum(np.square(p))

    r, alpha, a, b = fitted.params
    best = np.array([r, alpha * scale, a, b])
    assert nll(best) == pytest.approx(fitted.nll, abs=1e-9)
    rng = np.random.default_rng(0)
    assert all(nll(best * np.exp(rng.normal(0, s, 4))) >= fitted.nll - 1e-9 for s in (0.01, 0.1, 0.5) for _ in range(40))


@pytest.mark.parametrize("loglik, point, money", [
    (purchase_models.bgnbd_loglik, (0.3, 1.1, -0.4, 0.7), False), (purchase_models.pareto_loglik, (0.3, 1.1, -0.4, 0.7), False),
    (purchase_models.pareto_loglik, (0.3, 0.7, -0.4, 1.1), False), (purchase_models.pareto_loglik, (0.1, 0.1, 0.1, 0.1), False),
    (purchase_models.gamma_gamma_loglik, (0.5, 0.9, 1.5), True)])
def test_derivatives_are_exact(loglik, point, money):
    x = np.array([1.0, 2.0, 7.0, 3.0])
    history = (x, np.array([3.0, 10.0, 55.0, 0.5])) if money else (x, np.array([0.5, 3.0, 6.0, 8.0]), np.array([9.0, 4.0, 6.5, 8.0]))
    point, step = np.array(point), 1e-4
    found = loglik(jets.log_variables(point), *history)
    assert np.allclose(found.v, loglik(np.exp(point), *history), atol=1e-10)
    for i in range(len(point)):
        move = np.eye(len(point))[i] * step
        up, down = (loglik(jets.log_variables(point + s * move), *history) for s in (1, -1))
        assert np.allclose(found.g[i], (up.v - down.v) / (2 * step), atol=1e-6)
        assert np.allclose(found.h[i], (up.g - down.g) / (2 * step), atol=1e-5)


@pytest.mark.parametrize("kind", ["bgnbd", "pareto"])
def test_fits_take_few_jobs_and_give_errors(spark, kind):
    data = simulated(1500)
    df = spark.createDataFrame([(x, float(t), float(age)) for x, t, age in data], "frequency long, recency double, tenure double")
    fitted = purchase_models.fit_purchases(df, kind)
    assert fitted.jobs <= 15 and len(fitted.errors) == 4 and all(e > 0 for e in fitted.errors)
    twice = purchase_models.fit_purchases(df.union(df).union(df).union(df), kind)  # four times the data: half the error
    assert twice.params == pytest.approx(fitted.params, rel=1e-4)
    assert np.array(twice.errors) == pytest.approx(np.array(fitted.errors) / 2, rel=1e-3)


def test_expected_purchases_against_integration():
    """E by quadrature over the posterior of rate and dropout."""
    params, x, recency, age, t = (1.2, 20.0, 0.8 + 1.0, 2.5), 3.0, 50.0, 100.0, 60.0
    r, alpha, a, b = params
    rate = np.linspace(1e-5, 1.5, 3001)[:, None]
    drop = (np.linspace(0, 1, 2002)[1:-1])[None, :]
    prior = rate ** (r - 1) * np.exp(-alpha * rate) * drop ** (a - 1) * (1 - drop) ** (b - 1)
    alive = (1 - drop) ** x * rate ** x * np.exp(-rate * age)
    dead = drop * (1 - drop) ** (x - 1) * rate ** x * np.exp(-rate * recency)
    growth = (1 - np.exp(-rate * drop * t)) / drop
    expected = np.sum(prior * alive * growth) / np.sum(prior * (alive + dead))
    got = purchase_models.bgnbd_expected(params, t, *(np.array([v]) for v in (x, recency, age)))[0]
    assert got == pytest.approx(expected, rel=2e-3)


@pytest.mark.parametrize("params", [(1.5, 10.0, 2.2, 30.0), (1.5, 30.0, 2.2, 10.0)])
def test_pareto_against_integration(params):
    x, recency, age, t = 2.0, 20.0, 60.0, 40.0
    r, alpha, s, beta = params
    rate, death = np.linspace(1e-5, 1.6, 2000)[:, None], np.linspace(1e-5, 2.4, 2400)[None, :]
    import math

    prior = (alpha ** r / math.gamma(r) * rate ** (r - 1) * np.exp(-alpha * rate)
             * beta ** s / math.gamma(s) * death ** (s - 1) * np.exp(-beta * death))
    both = rate + death
    alive = rate ** x * np.exp(-both * age)
    like = rate ** (x + 1) / both * np.exp(-both * age) + death * rate ** x / both * np.exp(-both * recency)
    like = death * rate ** x / both * np.exp(-both * recency) + rate ** (x + 1) / both * np.exp(-both * age)
    cell = (rate[1, 0] - rate[0, 0]) * (death[0, 1] - death[0, 0])
    point = [np.array([v]) for v in (x, recency, age)]
    assert purchase_models.pareto_loglik(params, *point)[0] == pytest.approx(math.log(np.sum(prior * like) * cell), abs=5e-3)
    growth = rate / death * (1 - np.exp(-death * t))
    expected = np.sum(prior * alive * growth) / np.sum(prior * like)
    assert purchase_models.pareto_expected(params, t, *point)[0] == pytest.approx(expected, rel=5e-3)


def test_models_by_segment(spark):
    data = simulated(600, seed=4)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("hot" if i % 3 else "s", x, float(t), float(age), float(rng.gamma(6, 10)) if x else 0.0)
                                for i, (x, t, age) in enumerate(data)],
                               "rfm_segment string, frequency long, recency double, tenure double, monetary_value double")
    for made in (purchase_models.purchases_by_segment(df, "bgnbd"), purchase_models.purchases_by_segment(df, "pareto")):
        got = made.collect()
        assert len(got) == 2 and all(r.expected_number_of_purchases > 0 for r in got)
    model = purchase_models.fit_purchases(df)
    each = purchase_models.with_expected_purchases(df, model, 365).groupBy("rfm_segment").agg(F.avg("expected_number_of_purchases").alias("e"))
    direct = {r.rfm_segment: r.e for r in each.collect()}
    for r in purchase_models.purchases_by_segment(df, "bgnbd").collect():
        assert direct[r.rfm_segment] == pytest.approx(r.expected_number_of_purchases)
    values = {r.rfm_segment: r.expected_lifetime_value for r in purchase_models.value_by_segment(df).collect()}
    assert set(values) == {"hot", "s"} and all(v > 0 for v in values.values())


@pytest.mark.parametrize("z", [0.0, 0.3, 0.9])
def test_series_derivatives_cost_no_jet_products_per_term(monkeypatch, z):
    """Value and derivatives against differences of plain series; jets are multiplied a fixed number of times, not once a term."""
    import numpy as np

    from outcome_engine.functions import jets

    products = []
    times = jets.Jet.__mul__
    monkeypatch.setattr(jets.Jet, "__mul__", lambda x, y: products.append(1) or times(x, y))
    p = jets.log_variables([0.4, 0.8])
    start = np.array([v.v[0] for v in p])

    def series(b, c):
        return jets.hyp2f1(np.ones(1), b, c + b, (b - start[0]) * 0.1 + z)

    found = series(*p)
    assert len(products) <= 4
    at, step = np.array([0.4, 0.8]), 1e-4

    def plain(point):
        return float(series(*(np.array([v]) for v in np.exp(point)))[0])

    def moved(*moves):
        return plain(at + sum((m * step * np.eye(2)[i] for i, m in moves), np.zeros(2)))

    if z:  # differences step below 0 else, where the plain series is not meant for
        for i in range(2):
            assert found.g[i, 0] == pytest.approx((moved((i, 1)) - moved((i, -1))) / (2 * step), rel=1e-6)
            for j in range(2):
                mixed = (moved((i, 1), (j, 1)) - moved((i, 1), (j, -1)) - moved((i, -1), (j, 1)) + moved((i, -1), (j, -1))) / (4 * step**2)
                assert found.h[i, j, 0] == pytest.approx(mixed, rel=1e-4, abs=1e-5)
    else:  # 1 + b / (b + c) z + ...: only z's derivative is left at 0
        b, c = start
        assert found.v[0] == 1 and found.g[:, 0] == pytest.approx([b / (b + c) * 0.1 * b, 0.0])
