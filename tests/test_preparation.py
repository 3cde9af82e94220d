from dataclasses import replace
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubloom.config import RETAIL_NETWORK
from hubloom.operators.geography import hub_centroids, state_centroids, state_hub_distances
from hubloom.operators.items import build_order_items, lane_weeks, preparation_summary
from hubloom.operators.demand import demand_features, holdout_cutoff, naive_holdout, weekly_demand
from hubloom.operators.quantiles import exact_quantiles
from hubloom.sources.raw import RawTables, read_raw_csv

ORDERS = [
    ("o1", "c1", "delivered", datetime(2017, 1, 2, 0, 0)),      # first day of the window
    ("o2", "c2", "delivered", datetime(2018, 8, 19, 23, 59)),   # its last Sunday
    ("o3", "c1", "delivered", datetime(2018, 8, 20, 0, 0)),     # a day too late
    ("o4", "c1", "delivered", None),
    ("o5", "c1", "shipped", datetime(2017, 3, 1)),
    ("o6", "c3", "delivered", datetime(2017, 3, 1)),            # state not planned
    ("o7", "c1", "delivered", datetime(2017, 1, 1, 23, 59)),    # a day too early
]
ITEMS = [
    ("o1", 1, "p_home", "s_sp", 10.0, 1.0),
    ("o1", 2, "p_null", "s_sp", 20.0, 2.0),
    ("o1", 3, "p_home", "s_far", 30.0, 3.0),                    # seller outside the hubs
    ("o2", 1, "p_odd", "s_south", 40.0, 4.0),
    ("o2", 2, "p_missing", "s_south", 45.0, 4.5),               # product not listed
    ("o3", 1, "p_home", "s_sp", 50.0, 5.0),
    ("o4", 1, "p_home", "s_sp", 60.0, 6.0),
    ("o5", 1, "p_home", "s_sp", 70.0, 7.0),
    ("o6", 1, "p_home", "s_sp", 80.0, 8.0),
    ("o7", 1, "p_home", "s_sp", 90.0, 9.0),
]


@pytest.fixture(scope="module")
def raw(spark):
    return RawTables(
        geolocation=spark.createDataFrame(
            [("SP", -23.0, -46.0), ("SP", -24.0, -47.0), ("SP", -23.5, -46.5), ("PR", -25.0, -49.0),
             ("SC", -27.0, -50.0), ("RJ", -22.0, -43.0), ("XX", 5.0, 5.0)],
            "geolocation_state string, geolocation_lat double, geolocation_lng double"),
        orders=spark.createDataFrame(
            ORDERS, "order_id string, customer_id string, order_status string, "
                    "order_purchase_timestamp timestamp"),
        order_items=spark.createDataFrame(
            ITEMS, "order_id string, order_item_id int, product_id string, seller_id string, "
                   "price double, freight_value double"),
        customers=spark.createDataFrame(
            [("c1", "SP"), ("c2", "BA"), ("c3", "AM")], "customer_id string, customer_state string"),
        sellers=spark.createDataFrame(
            [("s_sp", "SP"), ("s_south", "SC"), ("s_far", "PE")], "seller_id string, seller_state string"),
        products=spark.createDataFrame(
            [("p_home", "cama"), ("p_null", None), ("p_odd", "flores")],
            "product_id string, product_category_name string"),
        category_translation=spark.createDataFrame(
            [("cama", "bed_bath_table"), ("flores", "flowers")],
            "product_category_name string, product_category_name_english string"),
    )


def test_order_items_keep_what_the_network_plans(raw):
    rows = {(r.order_id, r.order_item_id): r for r in build_order_items(raw, RETAIL_NETWORK).collect()}
    assert set(rows) == {("o1", 1), ("o1", 2), ("o2", 1), ("o2", 2)}
    assert rows["o1", 1].product_group == "home" and rows["o1", 1].hub == "HUB_SaoPaulo"
    assert rows["o1", 2].product_group == "other"
    assert rows["o2", 1].product_group == "other" and rows["o2", 1].hub == "HUB_South"
    assert rows["o2", 2].product_group == "other"
    assert rows["o1", 1].week == date(2017, 1, 2)
    assert rows["o2", 1].week == date(2018, 8, 13)


def test_items_do_not_depend_on_the_join_strategy(spark, raw):
    expected = build_order_items(raw, RETAIL_NETWORK).sort("order_id", "order_item_id").collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = build_order_items(raw, RETAIL_NETWORK).sort("order_id", "order_item_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled == expected


def test_weekly_grid_is_complete(raw):
    lanes = lane_weeks(build_order_items(raw, RETAIL_NETWORK))
    grid = weekly_demand(lanes, RETAIL_NETWORK)
    stats = grid.agg(F.count("*").alias("n"), F.sum("demand").alias("s"),
                     F.countDistinct("week").alias("weeks")).first()
    assert (stats.n, stats.s, stats.weeks) == (85 * 8 * 4, 4, 85)
    summary = {r.hub: (r["items"], r.weeks) for r in preparation_summary(lanes).collect()}
    assert summary == {"HUB_SaoPaulo": (2, 1), "HUB_South": (2, 1), "all": (4, 2)}


def test_csv_reader_matches_the_raw_tables(spark, raw, tmp_path):
    files = {
        "x_orders_dataset.csv": "order_id,customer_id,order_status,order_purchase_timestamp,"
                                "order_approved_at,order_delivered_carrier_date,"
                                "order_delivered_customer_date,order_estimated_delivery_date\n"
                                "o1,c1,delivered,2017-01-02 00:00:00,,,,\n",
        "x_order_items_dataset.csv": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,"
                                     "price,freight_value\no1,1,p_home,s_sp,2017-01-05 00:00:00,10.5,1.25\n",
        "x_customers_dataset.csv": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,"
                                   "customer_state\nc1,u,01000,\"sao paulo, sp\",SP\n",
        "x_sellers_dataset.csv": "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
                                 "s_sp,01000,sao paulo,SP\n",
        "x_products_dataset.csv": "product_id,product_category_name,product_name_lenght,"
                                  "product_description_lenght,product_photos_qty,product_weight_g,"
                                  "product_length_cm,product_height_cm,product_width_cm\n"
                                  "p_home,cama,1,1,1,1,1,1,1\n",
        "x_category_name_translation.csv": "product_category_name,product_category_name_english\n"
                                           "cama,bed_bath_table\n",
        "x_geolocation_dataset.csv": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,"
                                     "geolocation_city,geolocation_state\n01000,-23.5,-46.5,sao paulo,SP\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    tables = read_raw_csv(spark, str(tmp_path))
    row = build_order_items(tables, RETAIL_NETWORK).first()
    assert (row.customer_state, row.hub, row.product_group) == ("SP", "HUB_SaoPaulo", "home")
    assert (row.price, row.freight_value, row.week) == (10.5, 1.25, date(2017, 1, 2))
    assert tables.geolocation.first().geolocation_lat == -23.5


@pytest.mark.parametrize("few_rows,strips", [(100_000, 1024), (50, 4), (1, 8), (300, 2)])
def test_exact_quantiles_of_skewed_groups(spark, few_rows, strips):
    rng = np.random.default_rng(1)
    groups = {
        "one": rng.normal(0, 5, 1), "two": rng.normal(0, 5, 2),
        "wide": rng.uniform(-90, 90, 501), "even": rng.uniform(-3, 3, 400),
        "hot": np.concatenate([np.full(3000, 1.23456), rng.uniform(0, 2, 700)]),
        "large": rng.lognormal(0, 3, 5000),  # many different values of one key, most in few strips
        "split": np.array([0.9999, 1.0001] * 5),  # the middle ranks lie in two strips
        "grid": np.round(rng.uniform(-1, 1, 1000), 2),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double").selectExpr("k", "v", "-2 * v AS w")
    fractions = [0.0, 0.25, 0.5, 0.9]
    rows = exact_quantiles(frame, "k", ["v", "w"], fractions, few_rows, strips).collect()
    found = {(r.k, r.axis, r.fraction): r.value for r in rows}
    assert len(found) == len(rows) == len(groups) * 2 * len(fractions)
    for (k, axis, fraction), value in found.items():
        values = groups[k] if axis == "v" else -2 * groups[k]
        assert value == pytest.approx(np.quantile(values, fraction), abs=1e-12)


def test_centroids_and_distances(raw):
    centroids = state_centroids(raw.geolocation)
    sp = centroids.where("state = 'SP'").first()
    assert (sp.lat, sp.lng) == (-23.5, -46.5)
    hubs = {r.hub: (r.lat, r.lng) for r in hub_centroids(centroids, RETAIL_NETWORK).collect()}
    assert hubs["HUB_South"] == (-26.0, -49.5)  # mean of the two members that have points
    assert hubs["HUB_MG_RJ"] == (-22.0, -43.0)
    rows = state_hub_distances(centroids, RETAIL_NETWORK).collect()
    assert {(r.customer_state, r.hub) for r in rows} == {
        (s, h) for s in ("SP", "PR", "SC", "RJ") for h in RETAIL_NETWORK.hubs}
    assert all(r.km >= 0 for r in rows)
    assert [r.km for r in rows if (r.customer_state, r.hub) == ("SP", "HUB_SaoPaulo")] == [0.0]


def test_features_lag_within_series_and_split_by_week(spark):
    config = replace(RETAIL_NETWORK, states=("SP", "RJ"), holdout_weeks=2)
    monday = np.datetime64("2017-01-02")
    rows = [((monday + np.timedelta64(7 * w, "D")).astype(object), s, "home", 10 * i + w)
            for i, s in enumerate(("SP", "RJ")) for w in range(8)]
    demand = spark.createDataFrame(rows, "week date, customer_state string, product_group string, demand bigint")
    features = demand_features(demand, config)
    got = {(r.customer_state, r.t): (r.lag1, r.lag2, r.lag3, r.lag4) for r in features.collect()}
    assert len(got) == 8  # four of eight weeks are left per series
    assert got["SP", 4.0] == (3, 2, 1, 0) and got["RJ", 7.0] == (16, 15, 14, 13)
    assert holdout_cutoff(features, config).first().cutoff == date(2017, 2, 13)
    holdout = {(r.customer_state, r.week): r for r in naive_holdout(features, config).collect()}
    assert len(holdout) == 4
    row = holdout["RJ", date(2017, 2, 20)]
    assert (row.demand, row.forecast, row.residual) == (17, 14.5, 2.5)
