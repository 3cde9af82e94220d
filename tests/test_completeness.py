"""Nothing is dropped in silence, and the raw items are read once."""

from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hubloom import Planning
from hubloom.config import RETAIL_NETWORK, STAR_NETWORK
from hubloom.operators import costs, routing
from hubloom.sources.small import literal_table
from hubloom.sources.star import add_distance_freight

DISTANCES = {"customer_state": ["SP", "SP", "SP"], "hub": list(RETAIL_NETWORK.hubs), "km": [1.0, 2.0, 3.0]}
ITEMS = {"customer_state": ["SP", "RJ"], "hub": [RETAIL_NETWORK.hubs[0]] * 2, "product_group": ["home", "home"],
         "price": [1.0, 2.0], "freight_value": [10.0, 11.0]}


@pytest.mark.parametrize("use", [
    lambda items, km: costs.fit_freight_line(
        items.groupBy("customer_state", "hub").agg(F.count("*").alias("items"), F.sum("freight_value").alias("freight")), km),
    lambda items, km: routing.routing_features(items, km, RETAIL_NETWORK),
    add_distance_freight,
], ids=["freight line", "routing features", "distance freight"])
def test_a_state_without_distance_is_an_error(spark, use):
    items, km = literal_table(spark, **ITEMS), literal_table(spark, **DISTANCES)
    with pytest.raises(PySparkException, match="no distance for state RJ"):
        use(items, km).collect()
    assert use(items.filter("customer_state = 'SP'"), km).count() == 1


def test_a_hub_without_items_has_no_capacity(spark):
    hubs = RETAIL_NETWORK.hubs
    lanes = literal_table(spark, hub=list(hubs), units=[5.0, 4.0, 3.0])
    capacities = literal_table(spark, hub=list(hubs[:2]), capacity=[9.0, 1.0])
    found = {r.hub: (r.load, r.capacity, r.breach) for r in costs.policy_loads(lanes, capacities).collect()}
    assert found == {hubs[0]: (5.0, 9.0, False), hubs[1]: (4.0, 1.0, True), hubs[2]: (3.0, 0.0, True)}


@pytest.mark.parametrize("options", [{"models": True}, {"share_items": True}])
def test_shared_items_are_read_from_their_copy(spark, small_folder, options):
    planning = Planning.over_star(spark, small_folder, **options)
    sources = planning.items.inputFiles()
    assert sources and not any("lineitem" in f or "orders" in f for f in sources)
    assert planning.routing_profile.agg(F.sum("n")).first()[0] == planning.lanes.agg(F.sum("items")).first()[0]


def test_an_unfinished_routing_fit_is_an_error(spark, small_folder):
    planning = Planning.over_star(spark, small_folder, freight=False)
    config = replace(STAR_NETWORK, logistic_max_iter=2)
    with pytest.raises(RuntimeError, match="not converged in 2 iterations"):
        routing.fit_routing(planning.routing_profile, planning.distances, config)
