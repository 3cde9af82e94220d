from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hubloom.config import RETAIL_NETWORK
from hubloom.operators import costs, placement, scenarios, transport
from hubloom.sources.small import literal_table

HUBS = RETAIL_NETWORK.hubs
PLAN_KEYS = ["plan"]


def long_table(spark, matrix: dict[str, list[float]], name: str):
    rows = [(s, h, float(v)) for s, vs in matrix.items() for h, v in zip(HUBS, vs)]
    return literal_table(spark, customer_state=[r[0] for r in rows], hub=[r[1] for r in rows],
                         **{name: [r[2] for r in rows]})


def network(spark, km, flows, a=14.3, b=0.0105, peaks=(1.0, 1.0, 1.0)):
    return placement.network_row(
        long_table(spark, km, "km"), literal_table(spark, a=[a], b=[b]),
        long_table(spark, flows, "p"), literal_table(spark, hub=list(HUBS), peak=list(peaks)),
        RETAIL_NETWORK)


def plans(spark, cells, caps, net, holding=1.0):
    """cells: (plan, state, group, demand); caps: plan -> three capacities."""
    table = spark.createDataFrame(
        cells, "plan int, customer_state string, product_group string, demand double")
    limits = spark.createDataFrame(
        [(p, [float(c) for c in cs]) for p, cs in caps.items()], "plan int, multipliers array<double>")
    rows = placement.plan_rows(table, PLAN_KEYS).join(limits, PLAN_KEYS)
    return placement.capacity_columns(placement.attach_network(rows, net), F.col("multipliers")) \
        .withColumn("holding", F.lit(holding))


TOY_KM = {"SP": [0, 565, 511], "RS": [831, 279, 1310]}
TOY_FLOWS = {"SP": [0.8, 0.1, 0.1], "RS": [0.6, 0.3, 0.1]}
TOY_CELLS = [(p, s, "home", d) for p in (0, 1, 2) for s, d in (("SP", 100.0), ("RS", 50.0))]
TOY_CAPS = {0: [1000] * 3, 1: [30, 1000, 1000], 2: [30, 40, 50]}


@pytest.fixture(scope="module")
def toy(spark):
    return network(spark, TOY_KM, TOY_FLOWS)


def test_toy_costs(spark, toy):
    rows = plans(spark, TOY_CELLS, TOY_CAPS, toy)
    result = {r.plan: r for r in placement.evaluate_plans(rows).collect()}
    assert result[0].optimised_cost == pytest.approx(2441.475)
    assert result[1].optimised_cost == pytest.approx(2817.06)
    assert not result[2].feasible and result[2].optimised_cost is None and result[2].saving_pct is None
    policy = sum(d * p * (14.3 + 0.0105 * km + 1.0)
                 for s, d in (("SP", 100), ("RS", 50)) for p, km in zip(TOY_FLOWS[s], TOY_KM[s]))
    assert result[0].policy_cost == pytest.approx(policy)
    assert result[0].saving_pct == pytest.approx(100 * (policy - 2441.475) / policy)
    assert not result[0].policy_capacity_breach and result[1].policy_capacity_breach


def test_toy_placement(spark, toy):
    rows = plans(spark, TOY_CELLS, TOY_CAPS, toy)
    placed = placement.place_units(rows, PLAN_KEYS, RETAIL_NETWORK)
    units = {(r.plan, r.customer_state, r.hub): r.units for r in placed.collect()}
    expected = {(0, "SP"): [100, 0, 0], (0, "RS"): [0, 50, 0], (1, "SP"): [30, 0, 70], (1, "RS"): [0, 50, 0]}
    assert len(units) == 12  # the infeasible plan has no placement
    for (plan, state), by_hub in expected.items():
        assert [units[plan, state, h] for h in HUBS] == pytest.approx(by_hub)
    cost = costs.lane_costs(long_table(spark, TOY_KM, "km"), literal_table(spark, a=[14.3], b=[0.0105]))
    nearest = placement.placement_vs_nearest(placed.where("plan = 0").drop("plan"), cost).collect()
    assert {r.customer_state: r.chosen_hub for r in nearest} == {"SP": HUBS[0], "RS": HUBS[1]}
    assert all(r.is_nearest for r in nearest)


@pytest.mark.parametrize("ties", [False, True])
def test_random_plans_are_optimal(spark, ties):
    """Placement meets demand, keeps capacity, and costs what the dual bound says.

    A feasible placement whose cost equals a lower bound is optimal, so this needs no
    other solver.
    """
    rng = np.random.default_rng(11)
    states = [f"S{i}" for i in range(6)]
    distance = {s: list(np.round(rng.uniform(0, 20, 3)) * 100.0 if ties else rng.uniform(0, 2000, 3))
                for s in states}
    net = network(spark, distance, {s: [0.5, 0.3, 0.2] for s in states})
    cells, caps, demand = [], {}, {}
    for plan in range(150):
        amounts = rng.uniform(0, 50, (len(states), 2)) * (rng.random((len(states), 2)) > 0.2)
        cells += [(plan, s, g, float(amounts[i, j])) for i, s in enumerate(states)
                  for j, g in enumerate(("home", "tech"))]
        total = amounts.sum()
        caps[plan] = rng.dirichlet([1, 1, 1]) * total * rng.uniform(1.0001, 1.6)
        if plan % 5 == 0:   # zero capacities, all of it at one hub
            caps[plan] = np.roll([total * 1.01 + 1, 0, 0], plan // 5)
        if plan % 7 == 0:   # a state exactly fills a hub
            caps[plan] = np.array([amounts[0].sum(), total, total])
        if plan % 31 == 0:  # infeasible
            caps[plan] = np.full(3, total / 4)
        demand[plan] = amounts
    value = {r.plan: r for r in placement.evaluate_plans(
        plans(spark, cells, caps, net)).collect()}
    placed = placement.place_units(
        plans(spark, cells, caps, net), PLAN_KEYS, RETAIL_NETWORK).collect()
    x = {}
    for r in placed:
        i, j, h = states.index(r.customer_state), ("home", "tech").index(r.product_group), HUBS.index(r.hub)
        x.setdefault(r.plan, np.full((len(states), 2, 3), np.nan))[i, j, h] = r.units
    unit = 14.3 + 0.0105 * np.array([distance[s] for s in states]) + 1.0
    feasible = {p for p in caps if demand[p].sum() <= caps[p].sum()}
    assert set(x) == feasible and {p for p, r in value.items() if r.feasible} == feasible
    for plan in feasible:
        assert x[plan].min() >= -1e-9
        assert np.allclose(x[plan].sum(2), demand[plan], atol=1e-9)
        assert (x[plan].sum((0, 1)) <= caps[plan] + 1e-9).all()
        cost = (x[plan].sum(1) * unit).sum()
        assert cost == pytest.approx(value[plan].optimised_cost, abs=1e-4)


def test_stranded_demand_is_an_error(spark):
    net = network(spark, TOY_KM, {"SP": TOY_FLOWS["SP"]})
    with pytest.raises(PySparkException, match="no flow or distance for state RS"):
        placement.evaluate_plans(plans(spark, TOY_CELLS, TOY_CAPS, net)).collect()
    without = [(p, s, g, 0.0 if s == "RS" else d) for p, s, g, d in TOY_CELLS]
    rows = placement.evaluate_plans(plans(spark, without, TOY_CAPS, net)).collect()
    assert {r.plan: r.units for r in rows} == {0: 100.0, 1: 100.0, 2: 100.0}


def test_policy_cost_and_loads_as_joins(spark):
    demand = spark.createDataFrame([("SP", "home", 100.0), ("RS", "home", 50.0)],
                                   "customer_state string, product_group string, demand double")
    cost = costs.lane_costs(long_table(spark, TOY_KM, "km"), literal_table(spark, a=[14.3], b=[0.0105]))
    lanes = costs.policy_lanes(demand, long_table(spark, TOY_FLOWS, "p"), cost)
    expected = sum(d * p * (14.3 + 0.0105 * km + 1.0)
                   for s, d in (("SP", 100), ("RS", 50)) for p, km in zip(TOY_FLOWS[s], TOY_KM[s]))
    assert costs.policy_cost(lanes, 1.0).first().policy_cost == pytest.approx(expected)
    limits = literal_table(spark, hub=list(HUBS), capacity=[110.0, 24.0, 100.0])
    loads = {r.hub: (r.load, r.breach) for r in costs.policy_loads(lanes, limits).collect()}
    assert loads[HUBS[0]] == (pytest.approx(110.0), False)  # full is not a breach
    assert loads[HUBS[1]] == (pytest.approx(25.0), True)
    with pytest.raises(PySparkException, match="no flow or distance for state RS"):
        costs.policy_cost(costs.policy_lanes(
            demand, long_table(spark, {"SP": TOY_FLOWS["SP"]}, "p"), cost), 1.0).collect()


@pytest.fixture(scope="module")
def planned(spark):
    """A plan with a holdout of four weeks over two states and two groups."""
    rng = np.random.default_rng(3)
    cells = [(s, g) for s in ("SP", "RS") for g in ("home", "tech")]
    weeks = [np.datetime64("2018-07-02") + np.timedelta64(7 * w, "D") for w in range(4)]
    holdout = spark.createDataFrame(
        [(w.astype(object), s, g, float(np.round(rng.normal(0, 8), 2))) for w in weeks for s, g in cells],
        "week date, customer_state string, product_group string, residual double")
    plan = spark.createDataFrame([(s, g, 10.0 * (i + 1)) for i, (s, g) in enumerate(cells)],
                                 "customer_state string, product_group string, demand double")
    return plan, holdout


def test_scenarios_draw_from_the_cells_own_residuals(planned):
    plan, holdout = planned
    drawn = scenarios.scenario_demand(plan, holdout, RETAIL_NETWORK, count=300).collect()
    base = {(r.customer_state, r.product_group): r.demand for r in plan.collect()}
    history = {}
    for r in holdout.orderBy("week").collect():
        history.setdefault((r.customer_state, r.product_group), []).append(r.residual)
    assert len(drawn) == 300 * 4
    seen = {}
    for r in drawn:
        cell = r.customer_state, r.product_group
        options = [max(base[cell] + e, 0.0) for e in history[cell]]
        assert r.demand in options
        seen.setdefault(cell, []).append(options.index(r.demand))
    for picks in seen.values():  # every residual is drawn, about equally often
        assert np.bincount(picks, minlength=4).min() > 40
    again = scenarios.scenario_demand(plan, holdout, RETAIL_NETWORK, count=300).collect()
    other = scenarios.scenario_demand(plan, holdout, RETAIL_NETWORK, count=300, seed=8).collect()
    assert sorted(drawn) == sorted(again) != sorted(other)


def test_scenarios_need_residuals_for_every_cell(planned):
    plan, holdout = planned
    # raised inside a subquery, so it arrives as the plain Java error
    with pytest.raises(Exception, match="no holdout residuals for cell RS"):
        scenarios.scenario_demand(plan, holdout.where("customer_state = 'SP'"), RETAIL_NETWORK).collect()


def test_scenario_plan_has_no_shuffle_between_scenarios(spark, planned):
    plan, holdout = planned
    net = network(spark, TOY_KM, TOY_FLOWS, peaks=(90, 60, 60)).checkpoint()
    table = scenarios.evaluate_scenarios(
        scenarios.scenario_demand(plan, holdout, RETAIL_NETWORK), net, RETAIL_NETWORK)
    physical = table._jdf.queryExecution().executedPlan().toString()
    main = physical.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in physical.split("+- Subquery")[0]
    rows = table.collect()
    assert len(rows) == 200
    assert all(r.optimised_cost <= r.policy_cost + 1e-9 for r in rows if not r.policy_capacity_breach)
    summary = scenarios.saving_summary(table).first()
    saving = np.array([r.saving_pct for r in rows])
    assert (summary.scenarios, summary["mean"], summary["std"]) == (
        200, pytest.approx(saving.mean()), pytest.approx(saving.std(ddof=1)))
    assert (summary.p25, summary.p50, summary.p75) == pytest.approx(
        tuple(np.percentile(saving, [25, 50, 75])))
    bins = {r.bin: r for r in scenarios.saving_histogram(table, RETAIL_NETWORK).collect()}
    heights, edges = np.histogram(saving, 25)
    assert [bins[i].scenarios for i in range(25)] == heights.tolist()
    assert [bins[i].bin_start for i in range(25)] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_equal_savings(spark):
    table = spark.createDataFrame([(5.0,)] * 4, "saving_pct double")
    bins = {r.bin: r for r in scenarios.saving_histogram(table, RETAIL_NETWORK).collect()}
    heights, edges = np.histogram([5.0] * 4, 25)
    assert [bins[i].scenarios for i in range(25)] == heights.tolist()
    assert bins[0].bin_start == edges[0]


def test_sweep_saving_grows_with_capacity(spark, planned):
    plan, _ = planned
    net = network(spark, TOY_KM, TOY_FLOWS, peaks=(80, 50, 50))
    rows = scenarios.capacity_sensitivity(plan, net, RETAIL_NETWORK).orderBy("regional_capacity_frac").collect()
    assert [r.regional_capacity_frac for r in rows] == pytest.approx([i / 10 for i in range(11)])
    saving = [r.saving_pct for r in rows]
    assert all(b >= a - 1e-9 for a, b in zip(saving, saving[1:])) and saving[-1] > saving[0]


def test_whatif_checks_and_flags(spark, planned):
    plan, _ = planned
    net = network(spark, TOY_KM, TOY_FLOWS, peaks=(80, 50, 50))
    grid = scenarios.assumption_grid(spark, [0.1, 1.5], [0.0, 1.0])
    rows = {(r.capacity_headroom, r.holding_cost): r
            for r in scenarios.whatif(grid, plan, net, RETAIL_NETWORK).collect()}
    assert not rows[0.1, 1.0].feasible and rows[0.1, 1.0].optimised_cost is None
    assert rows[1.5, 1.0].optimised_cost < rows[1.5, 1.0].policy_cost
    assert 0 < rows[1.5, 1.0].saving_pct < 100
    assert rows[1.5, 1.0].optimised_cost - rows[1.5, 0.0].optimised_cost == pytest.approx(100.0)
    for bad in ([0.0], [5.1]):
        with pytest.raises(ValueError, match="capacity_headroom"):
            scenarios.assumption_grid(spark, bad, [1.0])
    with pytest.raises(ValueError, match="holding_cost"):
        scenarios.assumption_grid(spark, [1.0], [-1.0])
    unchecked = literal_table(spark, capacity_headroom=[9.0], holding_cost=[1.0])
    with pytest.raises(PySparkException, match="capacity_headroom must lie"):
        scenarios.whatif(unchecked, plan, net, RETAIL_NETWORK).collect()


@pytest.mark.parametrize("hubs", [1, 2, 4, 5, 6])
def test_any_number_of_hubs(spark, hubs):
    """Six states, random plans, every placement against its own dual bound."""
    rng = np.random.default_rng(hubs)
    config = replace(RETAIL_NETWORK, hub_members=tuple((f"H{k}", (f"S{k}",)) for k in range(hubs)), primary_hub="H0")
    states = [f"S{i}" for i in range(6)]
    km = rng.uniform(0, 2000, (len(states), hubs))
    lanes = [(s, h, float(km[i, k])) for i, s in enumerate(states) for k, h in enumerate(config.hubs)]
    column = dict(customer_state=[x[0] for x in lanes], hub=[x[1] for x in lanes])
    net = placement.network_row(
        literal_table(spark, **column, km=[x[2] for x in lanes]), literal_table(spark, a=[14.3], b=[0.0105]),
        literal_table(spark, **column, p=[1.0 / hubs] * len(lanes)),
        literal_table(spark, hub=list(config.hubs), peak=[1.0] * hubs), config)
    demand = rng.uniform(0, 50, (40, len(states))) * (rng.random((40, len(states))) > 0.2)
    caps = rng.dirichlet(np.ones(hubs), 40) * demand.sum(1)[:, None] * rng.uniform(1.0001, 1.6, (40, 1))
    cells = [(p, s, "home", float(demand[p, i])) for p in range(40) for i, s in enumerate(states)]
    rows = plans(spark, cells, dict(enumerate(caps)), net)
    value = {r.plan: r.optimised_cost for r in placement.evaluate_plans(rows).collect()}
    x = np.zeros((40, len(states), hubs))
    for r in placement.place_units(rows, PLAN_KEYS, config).collect():
        x[r.plan, states.index(r.customer_state), config.hubs.index(r.hub)] = r.units
    unit = np.broadcast_to(14.3 + 0.0105 * km, x.shape)
    prices = transport.hub_prices(unit, x)
    assert x.min() >= -1e-9 and np.allclose(x.sum(2), demand) and (x.sum(1) <= caps + 1e-6).all() and prices.min() >= -1e-9
    bound = (demand * (unit + prices[:, None]).min(2)).sum(1) - (prices * caps).sum(1)
    assert (x * unit).sum((1, 2)) == pytest.approx(bound, abs=1e-3)
    assert [value[p] for p in range(40)] == pytest.approx(list(bound + demand.sum(1)), abs=1e-3)


def test_many_states():
    """500 states and 200 plans; cost equals the dual bound."""
    rng = np.random.default_rng(4)
    costs_ = np.broadcast_to(rng.uniform(10, 40, (500, 3)), (8, 500, 3))
    demand = rng.uniform(0, 50, (200, 500))
    caps = rng.dirichlet(np.ones(3) * 3, 200) * demand.sum(1)[:, None] * 1.2
    for k in range(0, 200, 8):
        d, c = demand[k:k + 8], caps[k:k + 8]
        units = transport.cheapest_units(costs_, d, c)
        prices = transport.hub_prices(costs_, units)
        bound = (d * (costs_ + prices[:, None]).min(2)).sum(1) - (prices * c).sum(1)
        assert (units * costs_).sum((1, 2)) == pytest.approx(bound) and (units.sum(1) <= c + 1e-6).all()


def test_equal_costs_settle():
    """Whole-number costs: most paths tie."""
    rng = np.random.default_rng(6)
    costs_ = np.broadcast_to(rng.integers(0, 3, (30, 5)).astype(float), (50, 30, 5))
    demand = rng.integers(0, 9, (50, 30)).astype(float)
    caps = np.ceil(rng.dirichlet(np.ones(5), 50) * demand.sum(1)[:, None] * 1.1)
    units = transport.cheapest_units(costs_, demand, caps)
    prices = transport.hub_prices(costs_, units)
    bound = (demand * (costs_ + prices[:, None]).min(2)).sum(1) - (prices * caps).sum(1)
    assert (units * costs_).sum((1, 2)) == pytest.approx(bound) and np.allclose(units.sum(2), demand)


def test_cost_pieces_are_the_cost():
    rng = np.random.default_rng(8)
    for k in range(40):
        states, hubs = rng.integers(1, 30), rng.integers(2, 6)
        cost, demand = rng.uniform(10, 40, (states, hubs)), rng.uniform(0, 50, states)
        high = rng.dirichlet(np.ones(hubs)) * demand.sum() * 1.5
        low = np.zeros(hubs)
        low[0] = high[0] = demand.sum() * (0.3, 1.2)[k % 2]
        pieces = transport.value_pieces(cost, demand, low, high)
        if high.sum() < demand.sum():
            assert pieces == []
            continue
        assert pieces[0][0] == pytest.approx(max(0, (demand.sum() - low.sum()) / (high - low).sum())) and pieces[-1][1] == 1.0
        assert all(a[1] == b[0] and a[3] == b[2] for a, b in zip(pieces, pieces[1:]))
        slopes = [(d - c) / (b - a) for a, b, c, d in pieces]
        assert all(b > a for a, b in zip(slopes, slopes[1:]))
        at = rng.uniform(pieces[0][0], 1, 50)
        units = transport.cheapest_units(np.broadcast_to(cost, (50, states, hubs)), np.broadcast_to(demand, (50, states)),
                                         low + at[:, None] * (high - low))
        on_line = np.interp(at, [*[p[0] for p in pieces], 1.0], [*[p[2] for p in pieces], pieces[-1][3]])
        assert (units * cost).sum((1, 2)) == pytest.approx(on_line, abs=1e-6)


def test_sweep_points_lie_on_the_pieces(spark, planned):
    plan, _ = planned
    net = network(spark, TOY_KM, TOY_FLOWS, peaks=(80, 50, 50))
    points = scenarios.capacity_sensitivity(plan, net, RETAIL_NETWORK).orderBy("regional_capacity_frac").collect()
    pieces = scenarios.capacity_breakpoints(plan, net, RETAIL_NETWORK).orderBy("from_frac").collect()
    x, y = [*[p.from_frac for p in pieces], 1.0], [*[p.from_cost for p in pieces], pieces[-1].to_cost]
    assert [p.optimised_cost for p in points] == pytest.approx(np.interp([p.regional_capacity_frac for p in points], x, y).tolist())


def test_missing_hub_distance_names_both(spark):
    km = long_table(spark, TOY_KM, "km").where(f"NOT (customer_state = 'RS' AND hub = '{HUBS[1]}')")
    net = placement.network_row(km, literal_table(spark, a=[14.3], b=[0.01]), long_table(spark, TOY_FLOWS, "p"),
                                literal_table(spark, hub=list(HUBS), peak=[1.0] * 3), RETAIL_NETWORK)
    with pytest.raises(PySparkException, match=f"no distance from state RS to hub {HUBS[1]}"):
        net.collect()


def test_hubs_are_given_once():
    for members in ((), RETAIL_NETWORK.hub_members[:1] * 2):
        with pytest.raises(ValueError, match="hubs must be given"):
            replace(RETAIL_NETWORK, hub_members=members)
