"""DuckDB SQL for the registered queries, on the same parquet tables.

`STEPS` are named common table expressions; `assemble` puts the steps a query needs,
directly or through other steps, in front of it. The two model fits are solved here by
other means than in the engine: elimination for the ridge, a fixed-bound iteration on
single items for the multinomial.
"""

from __future__ import annotations

import re


def r(expression: str, digits: int = 6) -> str:
    """Half-up rounding in plain doubles."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({expression}) * {scale} + 0.5::DOUBLE) / {scale})"


HUBS = ["HUB_A", "HUB_E", "HUB_S"]
GROUPS = ["beauty_health", "home", "other", "tech"]
HEADROOMS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]
HOLDINGS = [0.0, 1.0, 5.0, 50.0]
FIT_STEPS = 200



def gauss_jordan(name: str, system: str) -> str:
    """Recursive elimination of a symmetric positive definite system (i, j, v), whose
    columns after the square part are right-hand sides; step k has cleared k columns."""
    return f"""
        SELECT 0 AS k, i, j, v FROM {system}
        UNION ALL
        SELECT k + 1, i, j, CASE WHEN i = k + 1 THEN in_row / lead_value
                                 ELSE v - in_column * in_row / lead_value END
        FROM (SELECT k, i, j, v, max(v) FILTER (i = k + 1) OVER (PARTITION BY j) AS in_row,
                     max(v) FILTER (j = k + 1) OVER (PARTITION BY i) AS in_column,
                     max(v) FILTER (i = k + 1 AND j = k + 1) OVER () AS lead_value
              FROM {name} WHERE k < (SELECT max(i) FROM {system}))"""


def hub_loads(key: str, plans: str) -> str:
    """Load of each hub in plans that have an optimal price: a priced hub is full, an
    unpriced one takes the states it is strictly cheapest for, and the rest goes to the
    unpriced hub that shares a state with another hub."""
    loaded = [f"c{i} + q{i}" for i in range(3)]
    lowest = f"least({', '.join(loaded)})"
    ties = [f"({c} <= {lowest} + 1e-9::DOUBLE)" for c in loaded]
    shared = f"({' + '.join(f'{t}::INT' for t in ties)} > 1)"
    per_plan = ", ".join(
        f"coalesce(sum(demand) FILTER (WHERE {t} AND NOT {shared}), 0) AS strict{i}, "
        f"bool_or({t} AND {shared}) AND any_value(q{i}) = 0 AS open{i}"
        for i, t in enumerate(ties))
    closed = ", ".join(
        f"CASE WHEN open{i} THEN NULL WHEN q{i} > 0 THEN cap{i} ELSE strict{i} END AS closed{i}"
        for i in range(3))
    rest = "units - " + " - ".join(f"coalesce(closed{i}, 0)" for i in range(3))
    return " UNION ALL ".join(
        f"SELECT {key}, '{hub}' AS hub, coalesce(closed{i}, {rest}) AS units FROM ("
        f"SELECT {key}, units, {closed} FROM ("
        f"SELECT {key}, sum(demand) AS units, {', '.join(f'any_value(q{j}) AS q{j}, any_value(cap{j}) AS cap{j}' for j in range(3))}, "
        f"{per_plan} FROM {plans} JOIN prices USING (price_id) CROSS JOIN wide_costs "
        f"JOIN state_plan USING (customer_state) GROUP BY {key}))"
        for i, hub in enumerate(HUBS))


def sweep_lines(plan: str, demand: str) -> str:
    """The value of every price as a line in the fraction of regional capacity."""
    return f"""
        SELECT {plan} AS plan, price_id,
               sum(demand * floor_cost) - any_value(15.0::DOUBLE * q2 * k2) + sum(demand) AS base,
               -any_value(1.5::DOUBLE * (q0 * k0 + q1 * k1)) AS slope
        FROM {demand} JOIN floors USING (customer_state), wide_peaks GROUP BY ALL"""


def envelope(name: str, lines: str) -> str:
    """The highest line of each plan from 0 on, and where a steeper one takes over."""
    return f"""
        SELECT plan, 0.0::DOUBLE AS frac, base, slope FROM (
          SELECT *, row_number() OVER (PARTITION BY plan ORDER BY round(base, 6) DESC, slope DESC) AS place FROM {lines})
        WHERE place = 1
        UNION ALL
        SELECT plan, frac, base, slope FROM (
          SELECT *, row_number() OVER (PARTITION BY plan ORDER BY round(frac, 9), slope DESC) AS place FROM (
            SELECT e.plan, (e.base - l.base) / (l.slope - e.slope) AS frac, l.base, l.slope
            FROM {name} e JOIN {lines} l ON l.plan = e.plan AND l.slope > e.slope + 1e-6))
        WHERE place = 1 AND frac < 1 - 1e-9"""


STEPS: dict[str, str] = {
    # geography
    "points": """
        SELECT n_name AS state,
               -30.0::DOUBLE + 1.5::DOUBLE * ((c_nationkey * 7) % 25)
                 + ((c_custkey % 101) - 50) / 100.0::DOUBLE AS lat,
               -65.0::DOUBLE + 1.2::DOUBLE * ((c_nationkey * 11) % 25)
                 + (((c_custkey * 37) % 101) - 50) / 100.0::DOUBLE AS lng
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "centroids": "SELECT state, median(lat) AS lat, median(lng) AS lng FROM points GROUP BY state",
    "members": """
        SELECT n_nationkey, n_name AS state,
               CASE n_nationkey % 5 WHEN 1 THEN 'HUB_A' WHEN 3 THEN 'HUB_E' ELSE 'HUB_S' END AS hub
        FROM nation WHERE n_nationkey % 5 <> 4""",
    "hub_points": """
        SELECT hub, avg(lat) AS lat, avg(lng) AS lng
        FROM centroids JOIN members USING (state) GROUP BY hub""",
    "planned": "SELECT n_nationkey, n_name AS customer_state FROM nation WHERE n_nationkey < 8",
    "distances": """
        SELECT customer_state, h.hub,
               2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
                 pow(sin(radians(h.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(h.lat))
                 * pow(sin(radians(h.lng - s.lng) / 2), 2)))) AS km
        FROM planned JOIN centroids s ON s.state = customer_state, hub_points h""",
    # items
    "base_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, date_trunc('week', o_orderdate)::DATE AS week,
               customer_state, m.hub,
               CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'home'
                    WHEN p_type = 'ECONOMY' THEN 'beauty_health'
                    WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'tech' ELSE 'other' END AS product_group,
               l_extendedprice AS price, l_quantity
        FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey
        JOIN planned p ON p.n_nationkey = c_nationkey
        JOIN supplier ON s_suppkey = l_suppkey
        JOIN members m ON m.n_nationkey = s_nationkey
        LEFT JOIN part ON p_partkey = l_partkey
        WHERE o_orderstatus = 'F'
          AND date_trunc('week', o_orderdate)::DATE BETWEEN DATE '1999-12-06' AND DATE '2001-07-22'""",
    "items": """
        SELECT b.* EXCLUDE (l_quantity),
               10.0::DOUBLE + 0.2::DOUBLE * l_quantity + 0.01::DOUBLE * km AS freight_value
        FROM base_items b JOIN distances USING (customer_state, hub)""",
    # demand
    "bounds": "SELECT min(week) AS first_week, max(week) AS last_week FROM base_items",
    "weeks": """
        SELECT unnest(generate_series(first_week, last_week, INTERVAL 7 DAY))::DATE AS week
        FROM bounds""",
    "groups": f"SELECT unnest({GROUPS!r}) AS product_group",
    "counts": """
        SELECT week, customer_state, product_group, count(*) AS n
        FROM base_items GROUP BY ALL""",
    "demand": """
        SELECT week, customer_state, product_group, coalesce(n, 0)::BIGINT AS demand
        FROM weeks CROSS JOIN (SELECT customer_state FROM planned) CROSS JOIN groups
        LEFT JOIN counts USING (week, customer_state, product_group)""",
    "features": """
        SELECT * FROM (
          SELECT week, customer_state, product_group, demand,
                 customer_state || '|' || product_group AS series,
                 lag(demand, 1) OVER w AS lag1, lag(demand, 2) OVER w AS lag2,
                 lag(demand, 3) OVER w AS lag3, lag(demand, 4) OVER w AS lag4,
                 date_diff('day', (SELECT min(week) FROM demand), week) / 7.0::DOUBLE AS t,
                 sin(2.0::DOUBLE * pi() * weekofyear(week) / 52) AS sin1,
                 cos(2.0::DOUBLE * pi() * weekofyear(week) / 52) AS cos1,
                 sin(4.0::DOUBLE * pi() * weekofyear(week) / 52) AS sin2,
                 cos(4.0::DOUBLE * pi() * weekofyear(week) / 52) AS cos2
          FROM demand
          WINDOW w AS (PARTITION BY customer_state, product_group ORDER BY week))
        WHERE lag4 IS NOT NULL""",
    "cutoff": """
        SELECT min(week) AS cutoff
        FROM (SELECT DISTINCT week FROM features ORDER BY week DESC LIMIT 8)""",
    "holdout": """
        SELECT *, demand - forecast AS residual FROM (
          SELECT week, customer_state, product_group, demand,
                 (lag1 + lag2 + lag3 + lag4) / 4.0::DOUBLE AS forecast
          FROM features WHERE week >= (SELECT cutoff FROM cutoff))""",
    "plan": """
        SELECT customer_state, product_group, avg(forecast) AS demand
        FROM holdout GROUP BY ALL""",
    # ridge: normal equations on centred training rows, solved by elimination
    "design": """
        SELECT week, customer_state, product_group, series, demand, demand::DOUBLE AS y,
               week >= cutoff AS is_holdout, feature, x
        FROM features, cutoff, LATERAL (VALUES ('t', t), ('sin1', sin1), ('cos1', cos1), ('sin2', sin2),
             ('cos2', cos2), ('lag1', lag1::DOUBLE), ('lag2', lag2::DOUBLE), ('lag3', lag3::DOUBLE),
             ('lag4', lag4::DOUBLE)) numeric_features(feature, x)
        UNION ALL
        SELECT week, customer_state, product_group, f.series, demand, demand::DOUBLE,
               week >= cutoff, 's_' || s.series, (f.series = s.series)::INT::DOUBLE
        FROM features f, cutoff, (SELECT DISTINCT series FROM features) s""",
    "feature_means": """
        SELECT feature, avg(x) AS mean_x, avg(y) AS mean_y, row_number() OVER (ORDER BY feature) AS pos,
               count(*) OVER () AS total
        FROM design WHERE NOT is_holdout GROUP BY feature""",
    "centred": """
        SELECT week, series, pos, total, x - mean_x AS x, y - mean_y AS y
        FROM design JOIN feature_means USING (feature) WHERE NOT is_holdout""",
    "gram": """
        SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) + CASE WHEN a.pos = b.pos THEN 3.0::DOUBLE ELSE 0 END AS v
        FROM centred a JOIN centred b USING (week, series) GROUP BY a.pos, b.pos
        UNION ALL SELECT pos, total + 1, sum(x * y) FROM centred GROUP BY pos, total""",
    "elimination": gauss_jordan("elimination", "gram"),
    "betas": """
        SELECT feature, v AS beta, mean_x, mean_y
        FROM elimination JOIN feature_means ON i = pos WHERE k = total AND j = total + 1""",
    "ridge": """
        SELECT *, demand - forecast AS residual FROM (
          SELECT week, customer_state, product_group, demand,
                 greatest(any_value(mean_y) + sum((x - mean_x) * beta), 0.0::DOUBLE) AS forecast
          FROM design JOIN betas USING (feature) WHERE is_holdout GROUP BY ALL)""",
    # routing
    "flows": """
        SELECT customer_state, hub, coalesce(n, 0) / total::DOUBLE AS p
        FROM (SELECT customer_state, count(*) AS total FROM base_items GROUP BY ALL)
        CROSS JOIN (SELECT DISTINCT hub FROM members)
        LEFT JOIN (SELECT customer_state, hub, count(*) AS n FROM base_items GROUP BY ALL)
          USING (customer_state, hub)""",
    "split": """
        SELECT *, row_number() OVER (PARTITION BY hub ORDER BY draw) <= floor(count(*) OVER (PARTITION BY hub) / 5 + 0.5::DOUBLE) AS is_test
        FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', order_id, order_item_id, product_id, seller_id,
                floor(price * 100 + 0.5::DOUBLE)::BIGINT)), 1, 15))::BIGINT AS draw
              FROM base_items)""",
    # multinomial fit on single items, with an upper bound B of the curvature: each step is
    # w <- inverse(B) X' (z/2 - p + y), z being the scores X w; the bound makes it converge
    "wide_distances": "SELECT customer_state, " + ", ".join(
        f"max(km) FILTER (hub = '{h}') / 1000.0::DOUBLE AS d{i}" for i, h in enumerate(HUBS))
        + " FROM distances GROUP BY customer_state",
    "route_rows": "SELECT row_number() OVER () AS item, *, CASE hub "
        + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(HUBS)) + " END AS y FROM split",
    "route_design": f"""
        SELECT item, is_test, customer_state, y, pos, x
        FROM route_rows JOIN wide_distances USING (customer_state),
        LATERAL (VALUES (1, d0), (2, d1), (3, d2), (4, ln(1 + price)), (5, 1.0::DOUBLE)) numeric_features(pos, x)
        UNION ALL
        SELECT item, is_test, customer_state, y, 5 + level, (name IN (product_group, customer_state))::INT::DOUBLE
        FROM route_rows, (SELECT row_number() OVER (ORDER BY name) AS level, name
                          FROM (SELECT product_group AS name FROM groups
                                UNION ALL SELECT customer_state FROM planned))""",
    "route_train": "SELECT item, y, pos, x FROM route_design WHERE NOT is_test",
    "route_bound": """
        SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / 2
               + CASE WHEN a.pos = b.pos AND a.pos <> 5 THEN 1.0::DOUBLE ELSE 0 END AS v
        FROM route_train a JOIN route_train b USING (item) GROUP BY a.pos, b.pos
        UNION ALL
        SELECT a.pos, b.pos + total, (a.pos = b.pos)::INT::DOUBLE
        FROM (SELECT DISTINCT pos FROM route_train) a, (SELECT DISTINCT pos FROM route_train) b,
             (SELECT max(pos) AS total FROM route_train)""",
    "route_solved": gauss_jordan("route_solved", "route_bound"),
    "route_inverse": """
        SELECT i, j - k AS j, v FROM route_solved
        WHERE k = (SELECT max(pos) FROM route_train) AND j > k""",
    "route_fit": f"""
        SELECT 0 AS step, class, pos, 0.0::DOUBLE AS w
        FROM (SELECT unnest(range(3)) AS class), (SELECT DISTINCT pos FROM route_train)
        UNION ALL
        SELECT step + 1, class, i, sum(v * pull) FROM (
          SELECT step, class, pos, sum(x * residual) AS pull FROM (
            SELECT step, item, class,
                   z / 2 - exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY item)
                     + (y = class)::INT AS residual
            FROM (SELECT *, max(z) OVER (PARTITION BY item) AS top FROM (
              SELECT step, item, class, any_value(y) AS y, sum(x * w) AS z
              FROM route_fit JOIN route_train USING (pos) WHERE step < {FIT_STEPS}
              GROUP BY step, item, class)))
          JOIN route_train USING (item) GROUP BY step, class, pos)
        JOIN route_inverse ON j = pos GROUP BY step, class, i""",
    "route_scores": f"""
        SELECT item, is_test, customer_state, y, class,
               exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY item) AS p
        FROM (SELECT *, max(z) OVER (PARTITION BY item) AS top FROM (
          SELECT item, is_test, customer_state, y, class, sum(x * w) AS z
          FROM route_design JOIN route_fit USING (pos) WHERE step = {FIT_STEPS}
          GROUP BY ALL))""",
    "route_flows": "SELECT customer_state, CASE class "
        + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HUBS))
        + " END AS hub, avg(p) AS p FROM route_scores GROUP BY customer_state, class",
    # costs
    "line": """
        SELECT regr_intercept(freight_value, km) AS a, regr_slope(freight_value, km) AS b
        FROM items JOIN distances USING (customer_state, hub)""",
    "costs": "SELECT customer_state, hub, km, a + b * km AS unit_cost FROM distances, line",
    "peaks": """
        SELECT hub, max(n) AS peak
        FROM (SELECT hub, week, count(*) AS n FROM base_items GROUP BY ALL) GROUP BY hub""",
    "policy_units": """
        SELECT customer_state, product_group, hub, demand * p AS units, unit_cost
        FROM plan JOIN flows USING (customer_state) JOIN costs USING (customer_state, hub)""",
    # placement: candidate prices and what a unit of each state costs under them
    "ties": """
        SELECT child.hub AS child, parent.hub AS parent, parent.unit_cost - child.unit_cost AS gap
        FROM costs child JOIN costs parent USING (customer_state) WHERE child.hub <> parent.hub""",
    "tie_sets": """
        SELECT '' AS h1, 0.0::DOUBLE AS p1, '' AS h2, 0.0::DOUBLE AS p2
        UNION ALL SELECT child, gap, '', 0.0 FROM ties
        UNION ALL SELECT t.child, t.gap, u.child,
                         u.gap + CASE WHEN u.parent = t.child THEN t.gap ELSE 0.0::DOUBLE END
                  FROM ties t JOIN ties u ON t.child <> u.child AND t.parent <> u.child""",
    "prices": """
        SELECT row_number() OVER () AS price_id, * FROM (
          SELECT DISTINCT """ + ", ".join(
              f"CASE '{h}' WHEN h1 THEN p1 WHEN h2 THEN p2 ELSE 0.0::DOUBLE END AS q{i}"
              for i, h in enumerate(HUBS)) + """
          FROM tie_sets WHERE p1 >= 0 AND p2 >= 0)""",
    "wide_costs": "SELECT customer_state, " + ", ".join(
        f"max(unit_cost) FILTER (hub = '{h}') AS c{i}" for i, h in enumerate(HUBS))
        + " FROM costs GROUP BY customer_state",
    "floors": """
        SELECT price_id, q0, q1, q2, customer_state, least(c0 + q0, c1 + q1, c2 + q2) AS floor_cost
        FROM prices CROSS JOIN wide_costs""",
    "wide_peaks": "SELECT " + ", ".join(
        f"coalesce(max(peak) FILTER (hub = '{h}'), 0)::DOUBLE AS k{i}"
        for i, h in enumerate(HUBS)) + " FROM peaks",
    "policy_rates": """
        SELECT customer_state, sum(p * unit_cost) AS shipping, sum(p) AS shipped, """ + ", ".join(
            f"max(p) FILTER (hub = '{h}') AS s{i}" for i, h in enumerate(HUBS)) + """
        FROM flows JOIN costs USING (customer_state, hub) GROUP BY customer_state""",
    "state_plan": "SELECT customer_state, sum(demand) AS demand FROM plan GROUP BY customer_state",
    # scenarios
    "histories": """
        SELECT customer_state, product_group, list(residual ORDER BY week) AS residuals
        FROM holdout GROUP BY ALL""",
    "scenario_cells": """
        SELECT scenario, customer_state, product_group,
               greatest(demand + residuals[1 + ('0x' || substr(md5(concat_ws('|', 7, scenario,
                 customer_state, product_group)), 1, 8))::BIGINT % len(residuals)], 0.0::DOUBLE) AS demand
        FROM (SELECT unnest(range(200)) AS scenario), plan JOIN histories
          USING (customer_state, product_group)""",
    "scenario_states": """
        SELECT scenario, customer_state, sum(demand) AS demand
        FROM scenario_cells GROUP BY ALL""",
    "scenario_best": """
        SELECT scenario, max(value) AS dual FROM (
          SELECT scenario, price_id,
                 sum(demand * floor_cost) - 1.5::DOUBLE * any_value(q0 * k0 + q1 * k1 + q2 * k2) AS value
          FROM scenario_states JOIN floors USING (customer_state), wide_peaks
          GROUP BY scenario, price_id)
        GROUP BY scenario""",
    "scenario_policy": """
        SELECT scenario, sum(demand) AS units, sum(demand * (shipping + shipped)) AS policy_cost,
               sum(demand * s0) > any_value(1.5::DOUBLE * k0) OR sum(demand * s1) > any_value(1.5::DOUBLE * k1)
                 OR sum(demand * s2) > any_value(1.5::DOUBLE * k2) AS policy_capacity_breach,
               sum(demand) <= any_value(1.5::DOUBLE * (k0 + k1 + k2)) AS feasible
        FROM scenario_states JOIN policy_rates USING (customer_state), wide_peaks
        GROUP BY scenario""",
    "scenario_table": """
        SELECT scenario, policy_cost, optimised_cost,
               100.0::DOUBLE * (policy_cost - optimised_cost) / policy_cost AS saving_pct,
               policy_capacity_breach
        FROM (SELECT *, CASE WHEN feasible THEN dual + units END AS optimised_cost
              FROM scenario_policy JOIN scenario_best USING (scenario))""",
    # plans that vary capacity: name, multiplier of each hub's peak, holding
    "sweep": """
        SELECT i / 10.0::DOUBLE AS frac, 1.5::DOUBLE * (i / 10.0::DOUBLE) AS m0,
               1.5::DOUBLE * (i / 10.0::DOUBLE) AS m1, 15.0::DOUBLE AS m2
        FROM (SELECT unnest(range(11)) AS i)""",
    "sweep_table": """
        SELECT frac, max(value) + any_value(units) AS optimised_cost, any_value(cost) AS policy_cost,
               any_value(units) AS units
        FROM (SELECT frac, price_id, sum(demand) AS units, sum(demand * (shipping + shipped)) AS cost,
                     sum(demand * floor_cost)
                       - any_value(q0 * k0 * m0 + q1 * k1 * m1 + q2 * k2 * m2) AS value
              FROM state_plan JOIN policy_rates USING (customer_state)
                JOIN floors USING (customer_state), sweep, wide_peaks
              GROUP BY frac, price_id)
        GROUP BY frac""",
    "assumptions": f"""
        SELECT headroom, holding FROM
          (SELECT unnest({HEADROOMS!r})::DOUBLE AS headroom), (SELECT unnest({HOLDINGS!r})::DOUBLE AS holding)""",
    "whatif": """
        SELECT headroom, holding, units <= headroom * (k0 + k1 + k2) AS feasible,
               shipping + holding * shipped AS policy_cost,
               CASE WHEN units <= headroom * (k0 + k1 + k2) THEN dual + holding * units END AS optimised_cost
        FROM (SELECT headroom, holding, max(value) AS dual, any_value(units) AS units,
                     any_value(shipping) AS shipping, any_value(shipped) AS shipped
              FROM (SELECT headroom, holding, price_id, sum(demand) AS units,
                           sum(demand * shipping) AS shipping, sum(demand * shipped) AS shipped,
                           sum(demand * floor_cost)
                             - headroom * any_value(q0 * k0 + q1 * k1 + q2 * k2) AS value
                    FROM state_plan JOIN policy_rates USING (customer_state)
                      JOIN floors USING (customer_state), assumptions, wide_peaks
                    GROUP BY headroom, holding, price_id)
              GROUP BY headroom, holding), wide_peaks""",
    "sweep_units": """
        SELECT frac, k0 * m0 AS cap0, k1 * m1 AS cap1, k2 * m2 AS cap2, price_id FROM (
          SELECT frac, arg_max(price_id, value) AS price_id FROM (
            SELECT frac, price_id, sum(demand * floor_cost)
                     - any_value(q0 * k0 * m0 + q1 * k1 * m1 + q2 * k2 * m2) AS value
            FROM state_plan JOIN floors USING (customer_state), sweep, wide_peaks
            GROUP BY frac, price_id) GROUP BY frac) JOIN sweep USING (frac), wide_peaks""",
    "sweep_loads": hub_loads("frac", "sweep_units"),
    # the sweep as lines in the fraction of regional capacity, and their upper envelope
    "sweep_lines": sweep_lines("0", "state_plan"),
    "sweep_envelope": envelope("sweep_envelope", "sweep_lines"),
    "scenario_lines": sweep_lines("scenario", "scenario_states"),
    "scenario_envelope": envelope("scenario_envelope", "scenario_lines"),
    "whatif_units": """
        SELECT headroom, headroom * k0 AS cap0, headroom * k1 AS cap1, headroom * k2 AS cap2, price_id FROM (
          SELECT headroom, arg_max(price_id, value) AS price_id FROM (
            SELECT headroom, price_id, sum(demand) AS units, sum(demand * floor_cost)
                     - headroom * any_value(q0 * k0 + q1 * k1 + q2 * k2) AS value
            FROM state_plan JOIN floors USING (customer_state),
                 (SELECT DISTINCT headroom FROM assumptions), wide_peaks
            GROUP BY headroom, price_id
            HAVING sum(demand) <= headroom * any_value(k0 + k1 + k2)) GROUP BY headroom), wide_peaks""",
    "whatif_loads": hub_loads("headroom", "whatif_units"),
    "cheapest": """
        SELECT customer_state, arg_min(hub, (unit_cost, hub)) AS hub
        FROM costs GROUP BY customer_state""",
    "placed": """
        SELECT customer_state, product_group, d.hub, CASE WHEN d.hub = c.hub THEN demand ELSE 0.0::DOUBLE END AS units
        FROM plan JOIN cheapest c USING (customer_state), (SELECT DISTINCT hub FROM members) d""",
}

ORACLES: dict[str, str] = {
    "raw_table_rows": """
        SELECT *, 0::BIGINT AS rejected FROM (
          SELECT 'geolocation' AS raw_table, count(*) AS rows FROM points
          UNION ALL SELECT 'orders', count(*) FROM orders
          UNION ALL SELECT 'order_items', count(*) FROM lineitem
          UNION ALL SELECT 'customers', count(*) FROM customer
          UNION ALL SELECT 'sellers', count(*) FROM supplier
          UNION ALL SELECT 'products', count(*) FROM part
          UNION ALL SELECT 'category_translation', count(DISTINCT p_type) FROM part)""",
    "state_centroids_sketch": f"""
        SELECT state, {r('quantile_disc(lat, 0.5)')} AS lat, {r('quantile_disc(lng, 0.5)')} AS lng
        FROM points GROUP BY state""",
    "store_round_trip": f"""
        SELECT stored_table, format, version, rows, {r('total')} AS total
        FROM (SELECT 'order_items' AS stored_table, 1 AS version, count(*) AS rows, sum(price) AS total
              FROM items WHERE product_group = 'home'
              UNION ALL SELECT 'order_items', 2, count(*), sum(price) FROM items
              UNION ALL SELECT 'weekly_demand', 1, count(*), sum(demand)::DOUBLE FROM demand WHERE demand > 0
              UNION ALL SELECT 'weekly_demand', 2, count(*), sum(demand)::DOUBLE FROM demand),
             (SELECT unnest(['parquet', 'csv']) AS format)""",
    "delivered_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, date_trunc('week', o_orderdate)::DATE AS week
        FROM orders WHERE o_orderstatus = 'F'
          AND date_trunc('week', o_orderdate)::DATE BETWEEN DATE '1999-12-06' AND DATE '2001-07-22'""",
    "product_groups": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'home'
                    WHEN p_type = 'ECONOMY' THEN 'beauty_health'
                    WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'tech' ELSE 'other' END AS product_group
        FROM part""",
    "order_items": f"""
        SELECT order_id, order_item_id, product_id, seller_id, week, customer_state, hub, product_group,
               {r('price')} AS price, {r('freight_value')} AS freight_value FROM items""",
    "preparation_summary": """
        SELECT hub, count(*) AS items, count(DISTINCT week) AS weeks FROM base_items GROUP BY hub
        UNION ALL SELECT 'all', count(*), count(DISTINCT week) FROM base_items""",
    "state_centroids": f"SELECT state, {r('lat')} AS lat, {r('lng')} AS lng FROM centroids",
    "hub_centroids": f"SELECT hub, {r('lat')} AS lat, {r('lng')} AS lng FROM hub_points",
    "state_hub_distances": f"SELECT customer_state, hub, {r('km')} AS km FROM distances",
    "calendar_bounds": "SELECT first_week, last_week FROM bounds",
    "weekly_demand": "SELECT week, customer_state, product_group, demand FROM demand",
    "reporting_weekly_demand":
        "SELECT week, customer_state, product_group, demand::INTEGER AS demand FROM demand",
    "weekly_group_totals": "SELECT week, " + ", ".join(
        f"sum(demand) FILTER (product_group = '{g}')::BIGINT AS {g}" for g in GROUPS)
        + " FROM demand GROUP BY week",
    "demand_features": "SELECT week, customer_state, product_group, demand, series, lag1, lag2, lag3, lag4, "
        + ", ".join(f"{r(c)} AS {c}" for c in ("t", "sin1", "cos1", "sin2", "cos2")) + " FROM features",
    "demand_design_totals": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'sum({c})::DOUBLE')} AS total FROM features"
        for c in ("t", "sin1", "cos1", "sin2", "cos2", "lag1", "lag2", "lag3", "lag4"))
        + " UNION ALL SELECT 's_' || series, count(*)::DOUBLE FROM features GROUP BY series",
    "holdout_weeks": """
        SELECT week, week >= cutoff AS is_holdout, count(*) AS rows
        FROM features, cutoff GROUP BY ALL""",
    "naive_holdout": f"""
        SELECT week, customer_state, product_group, demand, {r('forecast')} AS forecast,
               {r('residual')} AS residual FROM holdout""",
    "naive_accuracy": f"SELECT {r('avg(abs(residual))')} AS mae FROM holdout",
    "naive_holdout_totals": f"""
        SELECT week, sum(demand)::BIGINT AS demand, {r('sum(forecast)')} AS forecast
        FROM holdout GROUP BY week""",
    "naive_planning_demand": f"SELECT customer_state, product_group, {r('demand')} AS demand FROM plan",
    "naive_planning_totals": f"SELECT count(*) AS cells, {r('sum(demand)')} AS weekly_units FROM plan",
    "routing_metrics": f"""
        SELECT count(*) AS test_items, {r('avg(hit)')} AS accuracy, {r('avg(loss)')} AS log_loss
        FROM (SELECT item, (arg_max(class, p) = any_value(y))::INT AS hit,
                     -ln(max(p) FILTER (class = y)) AS loss
              FROM route_scores WHERE is_test GROUP BY item)""",
    "routing_model_flows": "SELECT customer_state, " + ", ".join(
        r(r(f"max(p) FILTER (hub = '{h}')", 4)) + f" AS {h}" for h in HUBS)
        + " FROM route_flows GROUP BY customer_state",
    "routing_flow_fit": f"""
        SELECT customer_state, {r('max(abs(m.p - e.p))')} AS max_abs_diff
        FROM route_flows m JOIN flows e USING (customer_state, hub) GROUP BY customer_state""",
    "ridge_coefficients": f"""
        SELECT feature, {r('beta')} AS coefficient FROM betas
        UNION ALL SELECT 'intercept', {r('any_value(mean_y) - sum(mean_x * beta)')} FROM betas""",
    "ridge_holdout": f"""
        SELECT week, customer_state, product_group, demand, {r('forecast')} AS forecast,
               {r('residual')} AS residual FROM ridge""",
    "ridge_accuracy": f"""
        SELECT {r('model')} AS model_mae, {r('naive')} AS naive_mae,
               {r('100.0::DOUBLE * (1 - model / naive)')} AS improvement_pct
        FROM (SELECT avg(abs(residual)) AS model FROM ridge), (SELECT avg(abs(residual)) AS naive FROM holdout)""",
    "ridge_holdout_totals": f"""
        SELECT week, sum(demand)::BIGINT AS demand, {r('sum(forecast)')} AS forecast
        FROM ridge GROUP BY week""",
    "ridge_planning_demand": f"""
        SELECT customer_state, product_group, {r('avg(forecast)')} AS demand FROM ridge GROUP BY ALL""",
    "empirical_flows": f"SELECT customer_state, hub, {r('p')} AS p FROM flows",
    "empirical_flow_matrix": "SELECT customer_state, " + ", ".join(
        r(r(f"max(p) FILTER (hub = '{h}')", 4)) + f" AS {h}" for h in HUBS)
        + " FROM flows GROUP BY customer_state",
    "routing_features": f"""
        SELECT order_id, order_item_id, product_id, seller_id, {r('price')} AS price, hub, product_group,
               customer_state, {r('d0')} AS "dist_HUB_A", {r('d1')} AS "dist_HUB_E",
               {r('d2')} AS "dist_HUB_S", {r('ln(1 + price)')} AS log_price
        FROM base_items JOIN (SELECT customer_state, """ + ", ".join(
            f"max(km) FILTER (hub = '{h}') / 1000.0::DOUBLE AS d{i}" for i, h in enumerate(HUBS))
        + " FROM distances GROUP BY customer_state) USING (customer_state)",
    "routing_design_totals": " UNION ALL ".join(
        f"SELECT 'dist_{h}' AS feature, {r('sum(km / 1000.0::DOUBLE)')} AS total"
        f" FROM base_items b JOIN distances d ON b.customer_state = d.customer_state AND d.hub = '{h}'"
        for h in HUBS)
        + f" UNION ALL SELECT 'log_price', {r('sum(ln(1 + price))')} FROM base_items"
        + " UNION ALL SELECT 'g_' || product_group, coalesce(n, 0)::DOUBLE FROM groups LEFT JOIN"
          " (SELECT product_group, count(*) AS n FROM base_items GROUP BY ALL) USING (product_group)"
        + " UNION ALL SELECT 'st_' || customer_state, coalesce(n, 0)::DOUBLE FROM planned LEFT JOIN"
          " (SELECT customer_state, count(*) AS n FROM base_items GROUP BY ALL) USING (customer_state)",
    "routing_split": "SELECT hub, is_test, count(*) AS items FROM split GROUP BY ALL",
    "routing_baseline": f"""
        SELECT sum(test)::BIGINT AS test_items, {r('max(test) / sum(test)::DOUBLE')} AS majority_accuracy,
               {r('''sum(-ln(least(greatest(train / total, pow(2.0::DOUBLE, -52)),
                   1.0::DOUBLE - pow(2.0::DOUBLE, -52))) * test) / sum(test)::DOUBLE''')}
                 AS share_baseline_log_loss
        FROM (SELECT hub, count(*) FILTER (is_test) AS test, (count(*) FILTER (NOT is_test))::DOUBLE AS train
              FROM split GROUP BY hub),
             (SELECT (count(*) FILTER (NOT is_test))::DOUBLE AS total FROM split)""",
    "freight_line": f"SELECT {r('a')} AS a, {r('b')} AS b FROM line",
    "lane_costs": f"SELECT customer_state, hub, {r('km')} AS km, {r('unit_cost')} AS unit_cost FROM costs",
    "hub_capacities": f"SELECT hub, {r('peak * 1.5::DOUBLE')} AS capacity FROM peaks",
    "policy_cost": f"SELECT {r('sum(units * (unit_cost + 1.0::DOUBLE))')} AS policy_cost FROM policy_units",
    "policy_hub_loads": f"""
        SELECT hub, {r('load')} AS load, {r('peak * 1.5::DOUBLE')} AS capacity, load > peak * 1.5::DOUBLE AS breach
        FROM (SELECT hub, sum(units) AS load FROM policy_units GROUP BY hub) JOIN peaks USING (hub)""",
    "placement_by_hub": f"SELECT hub, {r('sum(units)')} AS units FROM placed GROUP BY hub",
    "placement_vs_nearest": """
        SELECT customer_state, chosen_hub, c.hub AS nearest_hub, chosen_hub = c.hub AS is_nearest
        FROM (SELECT customer_state, arg_min(hub, (-units, hub)) AS chosen_hub
              FROM placed GROUP BY customer_state) JOIN cheapest c USING (customer_state)""",
    "hub_volumes": f"""
        SELECT hub, {r('policy_units')} AS policy_units, {r('optimised_units')} AS optimised_units
        FROM (SELECT hub, sum(units) AS policy_units FROM policy_units GROUP BY hub)
        JOIN (SELECT hub, sum(units) AS optimised_units FROM placed GROUP BY hub) USING (hub)""",
    "scenario_demand":
        f"SELECT scenario, customer_state, product_group, {r('demand')} AS demand FROM scenario_cells",
    "scenario_saving_summary": f"""
        SELECT count(saving_pct) AS scenarios, {r('avg(saving_pct)')} AS mean,
               {r('stddev_samp(saving_pct)')} AS std, {r('min(saving_pct)')} AS min,
               {r('quantile_cont(saving_pct, 0.25)')} AS p25, {r('quantile_cont(saving_pct, 0.5)')} AS p50,
               {r('quantile_cont(saving_pct, 0.75)')} AS p75, {r('max(saving_pct)')} AS max,
               {r('avg(policy_capacity_breach::INT)')} AS breach_rate
        FROM scenario_table""",
    "scenario_saving_histogram": f"""
        SELECT bin, {r('lo + bin * (hi - lo) / 25')} AS bin_start, coalesce(n, 0)::BIGINT AS scenarios
        FROM (SELECT unnest(range(25))::INTEGER AS bin)
        CROSS JOIN (SELECT min(saving_pct) AS lo, max(saving_pct) AS hi FROM scenario_table)
        LEFT JOIN (SELECT least(floor((saving_pct - lo) / (hi - lo) * 25), 24)::INTEGER AS bin, count(*) AS n
                   FROM scenario_table,
                        (SELECT min(saving_pct) AS lo, max(saving_pct) AS hi FROM scenario_table)
                   WHERE saving_pct IS NOT NULL GROUP BY 1) USING (bin)""",
    "capacity_breakpoints": f"""
        SELECT {r('frac')} AS from_frac, {r('til')} AS to_frac, {r('base + slope * frac')} AS from_cost,
               {r('base + slope * til')} AS to_cost
        FROM (SELECT *, lead(frac, 1, 1.0::DOUBLE) OVER (ORDER BY frac) AS til FROM sweep_envelope)""",
    "scenario_breakpoints": f"""
        SELECT plan AS scenario,
               {r('coalesce(max(til) FILTER (slope * (til - frac) < -1e-6), min(frac))')} AS enough_capacity_frac,
               {r('max(base + slope * frac)')} AS cost_without, {r('min(base + slope * til)')} AS cost_with
        FROM (SELECT *, lead(frac, 1, 1.0::DOUBLE) OVER (PARTITION BY plan ORDER BY frac) AS til FROM scenario_envelope)
        GROUP BY plan""",
    "sweep_placement_checks": f"""
        SELECT {r('frac')} AS regional_capacity_frac, {r('units')} AS units,
               {r(r('optimised_cost', 3))} AS placement_cost, true AS non_negative,
               0.0::DOUBLE AS demand_gap, 0.0::DOUBLE AS over_capacity
        FROM sweep_table""",
    "sweep_hub_units":
        f"SELECT {r('frac')} AS regional_capacity_frac, hub, {r(r('units', 3))} AS units FROM sweep_loads",
    "whatif_hub_units": f"""
        SELECT headroom AS capacity_headroom, holding AS holding_cost, hub, {r(r('units', 3))} AS units
        FROM whatif_loads JOIN assumptions USING (headroom)""",
    "whatif_summary": f"""
        SELECT headroom AS capacity_headroom, holding AS holding_cost, feasible,
               {r('policy_cost', 0)} AS current_policy_cost, {r('optimised_cost', 0)} AS optimised_cost,
               {r(r('100.0::DOUBLE * (policy_cost - optimised_cost) / policy_cost', 2))} AS saving_pct
        FROM whatif""",
    "whatif_answer": f"""
        SELECT headroom AS capacity_headroom, holding AS holding_cost, feasible,
               {r('policy_cost', 0)} AS current_policy_cost, {r('optimised_cost', 0)} AS optimised_cost,
               {r(r('100.0::DOUBLE * (policy_cost - optimised_cost) / policy_cost', 2))} AS saving_pct, """
        + ", ".join(f"units_{h}" for h in HUBS) + " FROM whatif LEFT JOIN (SELECT headroom, "
        + ", ".join(f"{r(f'sum(units) FILTER (hub = {q}{h}{q})', 0)} AS units_{h}" for h in HUBS for q in ["'"])
        + " FROM whatif_loads GROUP BY headroom) USING (headroom)",
    "reporting_order_items": """
        SELECT week, customer_state, hub, product_group, price::DECIMAL(38, 6)::VARCHAR AS price,
               freight_value::DECIMAL(38, 6)::VARCHAR AS freight_value
        FROM items""",
    "flow_share_report": f"""
        SELECT customer_state, hub,
               {r(r('count(*) / sum(count(*)) OVER (PARTITION BY customer_state)::DOUBLE', 3))} AS share
        FROM base_items GROUP BY customer_state, hub""",
    "moving_average_report": f"""
        SELECT week, customer_state, product_group, demand,
               {r(r('''avg(demand) OVER (PARTITION BY customer_state, product_group ORDER BY week
                        ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)''', 1))} AS demand_ma4
        FROM demand""",
    "hub_freight_report": f"""
        SELECT hub, count(*) AS items, {r(r('avg(freight_value)', 2))} AS avg_freight,
               {r('sum(freight_value)', 0)} AS total_freight
        FROM items GROUP BY hub""",
}


def plan_queries(digits: int) -> dict[str, str]:
    """Queries on a plan and its flows, from the naive forecast or from the models."""
    return {
        "plan_costs": f"""
            SELECT feasible, {r('units', digits)} AS units, {r('policy_cost', digits)} AS policy_cost,
                   {r('optimised_cost', digits)} AS optimised_cost,
                   {r('100.0::DOUBLE * (policy_cost - optimised_cost) / policy_cost', digits)} AS saving_pct,
                   (SELECT max(load > peak * 1.5::DOUBLE) FROM
                      (SELECT hub, sum(units) AS load FROM policy_units GROUP BY hub) JOIN peaks USING (hub))
                     AS policy_capacity_breach
            FROM (SELECT * FROM whatif WHERE headroom = 1.5 AND holding = 1.0),
                 (SELECT sum(demand) AS units FROM plan)""",
        "optimal_placement": f"SELECT customer_state, product_group, hub, {r('units', digits)} AS units FROM placed",
        "scenario_results": f"""
            SELECT scenario, {r('policy_cost', digits)} AS policy_cost, {r('optimised_cost', digits)} AS optimised_cost,
                   {r('saving_pct', digits)} AS saving_pct, policy_capacity_breach FROM scenario_table""",
        "capacity_sensitivity": f"""
            SELECT {r('frac', digits)} AS regional_capacity_frac, {r('optimised_cost', digits)} AS optimised_cost,
                   {r('100.0::DOUBLE * (policy_cost - optimised_cost) / policy_cost', digits)} AS saving_pct
            FROM sweep_table""",
        "whatif_grid": f"""
            SELECT headroom AS capacity_headroom, holding AS holding_cost, feasible,
                   {r('policy_cost', digits)} AS policy_cost, {r('optimised_cost', digits)} AS optimised_cost,
                   {r('100.0::DOUBLE * (policy_cost - optimised_cost) / policy_cost', digits)} AS saving_pct
            FROM whatif""",
    }


# Queries on the fitted models: the same SQL over the ridge holdout and the model's flows.
MODEL_ORACLES = {"plan_costs": "model_plan_costs", "optimal_placement": "model_placement",
                 "scenario_results": "model_scenario_results",
                 "capacity_sensitivity": "model_capacity_sensitivity",
                 "whatif_grid": "model_whatif_grid"}
MODEL_STEPS = {"holdout": "ridge", "flows": "route_flows"}


def oracle(name: str) -> str:
    return assemble(ORACLES[name], STEPS)


def model_oracle(name: str) -> str:
    """The SQL of a plan query with the models in the place of the simple estimates."""
    def swap(sql: str) -> str:
        for simple, fitted in MODEL_STEPS.items():
            sql = re.sub(rf"\b{simple}\b", fitted, sql)
        return sql

    steps = {step: sql if step in MODEL_STEPS else swap(sql) for step, sql in STEPS.items()}
    return assemble(plan_queries(2)[name], steps)


def assemble(body: str, steps: dict[str, str]) -> str:
    needed: set[str] = set()

    def need(sql: str) -> None:
        for step in steps:
            if step not in needed and re.search(rf"\b{step}\b", sql):
                needed.add(step)
                need(steps[step])

    def written(step: str) -> str:
        recursive = re.search(rf"\b{step}\b", steps[step])
        return f"{step} AS {'' if recursive else 'MATERIALIZED '}({steps[step]})"

    need(body)
    if not needed:
        return body
    # a step may only use steps written before it
    order: list[str] = []

    def place(step: str) -> None:
        if step not in order:
            for other in needed - {step}:
                if re.search(rf"\b{other}\b", steps[step]):
                    place(other)
            order.append(step)

    for step in steps:
        if step in needed:
            place(step)
    return "WITH RECURSIVE " + ",\n".join(written(step) for step in order) + "\n" + body


def all_oracles() -> dict[str, str]:
    simple = {name: oracle(name) for name in ORACLES}
    simple |= {name: assemble(sql, STEPS) for name, sql in plan_queries(6).items()}
    return simple | {fitted: model_oracle(name) for name, fitted in MODEL_ORACLES.items()}
