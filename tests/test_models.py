import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hubloom.config import RETAIL_NETWORK
from hubloom.operators import routing
from hubloom.operators.demand import demand_features
from hubloom.operators.forecast import feature_names, fit_ridge, model_frame, ridge_forecast
from hubloom.sources.small import literal_table

CONFIG = replace(RETAIL_NETWORK, states=("SP", "RJ", "BA"), holdout_weeks=4)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    monday = np.datetime64("2017-01-02")
    rows = [((monday + np.timedelta64(7 * w, "D")).astype(object), s, g, int(rng.poisson(3 + 4 * i + j)))
            for i, s in enumerate(CONFIG.states) for j, g in enumerate(CONFIG.groups) for w in range(40)]
    demand = spark.createDataFrame(
        rows, "week date, customer_state string, product_group string, demand bigint")
    return demand_features(demand, CONFIG)


def test_ridge_equals_the_closed_form(features):
    fitted = ridge_forecast(features, CONFIG)
    rows = model_frame(features, CONFIG).select(
        "week", "series", "is_holdout", F.col("demand").cast("double").alias("y"),
        vector_to_array("features").alias("x")).collect()
    assert len(rows[0].x) == len(feature_names(CONFIG)) == 9 + 12
    train = [r for r in rows if not r.is_holdout]
    x, y = np.array([r.x for r in train]), np.array([r.y for r in train])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + CONFIG.ridge_alpha * np.eye(x.shape[1]), xc.T @ yc)
    intercept = y.mean() - x.mean(0) @ beta
    found = {r.feature: r.coefficient for r in fitted.coefficients(CONFIG).collect()}
    assert np.allclose([found[f] for f in feature_names(CONFIG)], beta, atol=1e-8)
    assert found["intercept"] == pytest.approx(intercept, abs=1e-8)

    expected = {(str(r.week), r.series): max(np.array(r.x) @ beta + intercept, 0.0)
                for r in rows if r.is_holdout}
    got = {(str(r.week), f"{r.customer_state}|{r.product_group}"): r for r in fitted.holdout.collect()}
    assert got.keys() == expected.keys() and len(got) == 4 * 12
    for key, forecast in expected.items():
        assert got[key].forecast == pytest.approx(forecast, abs=1e-7)
        assert got[key].residual == pytest.approx(got[key].demand - forecast, abs=1e-7)


def test_ridge_with_thousands_of_series(spark):
    """More series than a dense solver takes, against the closed form on centred columns."""
    rng = np.random.default_rng(1)
    series, weeks, alpha = 4200, 3, 3.0
    z = rng.normal(size=(series * weeks, 2))
    of = np.repeat(np.arange(series), weeks)
    y = 5 + z @ [2.0, -1.0] + rng.normal(size=series)[of] + 0.1 * rng.normal(size=len(of))
    rows = literal_table(spark, series=[f"s{k}" for k in of], a=list(map(float, z[:, 0])),
                         b=list(map(float, z[:, 1])), demand=list(map(float, y)))
    intercept, weights, offsets = fit_ridge(rows, ["a", "b"], alpha)
    x = np.hstack([z, np.eye(series)[of]])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(weights, beta[:2], atol=1e-9)
    assert intercept == pytest.approx(y.mean() - x.mean(0) @ beta, abs=1e-9)
    found = {r.series: r.offset for r in offsets.collect()}
    assert np.allclose([found[f"s{k}"] for k in range(series)], beta[2:], atol=1e-9)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(9)
    n = 1500
    states, groups = rng.choice(CONFIG.states, n), rng.choice(CONFIG.groups, n)
    prices = np.round(rng.lognormal(3, 1, n), 1)
    pull = np.array([[s == "SP", s == "BA", s == "RJ"] for s in states]) * 1.2 + np.array([0.8, 0, 0.1])
    hub = [CONFIG.hubs[rng.choice(3, p=np.exp(u) / np.exp(u).sum())] for u in pull]
    return literal_table(
        spark, order_id=[f"o{i}" for i in range(n)], order_item_id=[1] * n,
        product_id=[f"p{i % 50}" for i in range(n)], seller_id=[f"s{i % 20}" for i in range(n)],
        customer_state=list(states), product_group=list(groups), hub=hub, price=list(map(float, prices)))


@pytest.fixture(scope="module")
def distances(spark):
    rng = np.random.default_rng(2)
    pairs = [(s, h) for s in CONFIG.states for h in CONFIG.hubs]
    return literal_table(spark, customer_state=[s for s, _ in pairs], hub=[h for _, h in pairs],
                         km=list(map(float, rng.uniform(0, 2000, len(pairs)))))


def _newton(x, y, l2):
    """Multinomial fit with |weights|^2 * l2 / 2 added to the sum of losses, free intercepts."""
    xi = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.tile(np.append(np.full(x.shape[1], l2), 0.0), 3)
    onehot = np.eye(3)[y]
    w = np.zeros((3, xi.shape[1]))
    for _ in range(100):
        z = xi @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = ((p - onehot).T @ xi).ravel() + penalty * w.ravel()
        d = xi.shape[1]
        hessian = np.diag(penalty)
        for a in range(3):
            for b in range(3):
                weight = p[:, a] * ((a == b) - p[:, b])
                hessian[a * d:(a + 1) * d, b * d:(b + 1) * d] += (xi * weight[:, None]).T @ xi
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        w -= step.reshape(w.shape)
        if np.abs(step).max() < 1e-12:
            break
    z = xi @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), w


def test_weighted_logistic_equals_newton_on_items(items, distances):
    profile = routing.routing_profile(items, CONFIG)
    fitted = routing.fit_routing(profile, distances, CONFIG)

    rows = (routing.routing_design(items.withColumn("draw", routing.split_draw()), distances, CONFIG)
            .select("draw", "customer_state", "hub", "label", vector_to_array("features").alias("x"))
            .collect())
    test = np.zeros(len(rows), bool)
    for hub in CONFIG.hubs:  # the first fifth of each hub's items by hash
        own = sorted((r.draw, k) for k, r in enumerate(rows) if r.hub == hub)
        test[[k for _, k in own[:math.floor(len(own) / 5 + 0.5)]]] = True
    assert fitted.steps <= 10
    x, y = np.array([r.x for r in rows]), np.array([int(r.label) for r in rows])
    _, w = _newton(x[~test], y[~test], 1.0)
    z = np.hstack([x, np.ones((len(x), 1))]) @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)

    states = np.array([r.customer_state for r in rows])
    flows = {(r.customer_state, r.hub): r.p for r in routing.model_flows(fitted.scored, CONFIG).collect()}
    assert len(flows) == 9
    for s in CONFIG.states:
        for i, h in enumerate(CONFIG.hubs):
            assert flows[s, h] == pytest.approx(p[states == s, i].mean(), abs=1e-6)
        assert sum(flows[s, h] for h in CONFIG.hubs) == pytest.approx(1.0)

    metrics = routing.routing_metrics(fitted.scored).first()
    assert metrics.test_items == test.sum()
    assert metrics.accuracy == pytest.approx((p[test].argmax(1) == y[test]).mean())
    assert metrics.log_loss == pytest.approx(-np.log(p[test, y[test]]).mean(), abs=1e-6)

    baseline = routing.baseline_metrics(profile, CONFIG).first()
    shares = np.bincount(y[~test], minlength=3) / (~test).sum()
    assert baseline.majority_accuracy == pytest.approx(np.bincount(y[test]).max() / test.sum())
    assert baseline.share_baseline_log_loss == pytest.approx(-np.log(shares[y[test]]).mean())


def test_class_missing_from_training_keeps_its_place(items, distances):
    two_hubs = items.where(F.col("hub") != CONFIG.hubs[2])
    fitted = routing.fit_routing(routing.routing_profile(two_hubs, CONFIG), distances, CONFIG)
    assert len(fitted.intercepts) == len(fitted.coefficients) == 3
    flows = routing.model_flows(fitted.scored, CONFIG).where(F.col("hub") == CONFIG.hubs[2])
    assert flows.agg(F.max("p")).first()[0] < 1e-3


def test_split_is_exact_by_hub(spark):
    """Also where one item is repeated: copies share a hash, and a part of them is taken."""
    rows = [(f"o{k}", 1, "p", "s", "SP", "home", "HUB_A" if k % 3 else "HUB_B", float(k % 7)) for k in range(1000)]
    rows += [("same", 1, "p", "s", "SP", "home", "HUB_C", 5.0)] * 42 + [("one", 1, "p", "s", "SP", "home", "HUB_D", 5.0)] * 2
    rows += [("same", 1, "p", "s", "RJ", "tech", "HUB_C", 5.0)] * 11
    items = spark.createDataFrame(rows, "order_id string, order_item_id int, product_id string, seller_id string, "
                                        "customer_state string, product_group string, hub string, price double")
    profile = routing.routing_profile(items, CONFIG).collect()
    count = lambda hub, test: sum(r.n for r in profile if r.hub == hub and r.is_test is test)
    sizes = {h: sum(x[6] == h for x in rows) for h in ("HUB_A", "HUB_B", "HUB_C", "HUB_D")}
    for hub, n in sizes.items():
        quota = math.floor(n / 5 + 0.5)
        assert (count(hub, True), count(hub, False)) == (quota, n - quota)
    assert {(r.customer_state, r.is_test): r.n for r in profile if r.hub == "HUB_C"} == {
        ("RJ", True): 11, ("SP", False): 42}
    assert len({(r.is_test, r.customer_state, r.product_group, r.hub, r.price) for r in profile}) == len(profile)
    assert routing.routing_profile(items.where("false"), CONFIG).count() == 0


def test_fit_needs_distances_and_converges(spark, items, distances):
    profile = routing.routing_profile(items, CONFIG).cache()
    some = distances.where(F.col("customer_state") != CONFIG.states[0])
    with pytest.raises(ValueError, match=f"no distance for state {CONFIG.states[0]}"):
        routing.fit_routing(profile, some, CONFIG)
    with pytest.raises(RuntimeError, match="not converged in 2"):
        routing.fit_routing(profile, distances, replace(CONFIG, logistic_max_iter=2))
    with pytest.raises(ValueError, match="no training items"):
        routing.fit_routing(profile.where("is_test"), distances, CONFIG)
