"""Order items of the planning network and their weekly lane summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.calendar import week_start
from hubloom.sources.raw import RawTables

ITEM_KEY = ["order_id", "order_item_id", "product_id", "seller_id"]
ITEM_COLUMNS = ["week", "customer_state", "hub", "product_group", "price", "freight_value"]


def delivered_orders(raw: RawTables, config: NetworkConfig) -> DataFrame:
    """Delivered orders whose purchase week lies in the window.

    The week bounds are written as bounds on the timestamp itself, in its own type,
    so that parquet row groups outside the window are skipped.
    """
    orders = raw.orders
    ts_type = orders.schema["order_purchase_timestamp"].dataType
    purchased = F.col("order_purchase_timestamp")
    return (orders
            .where(F.col("order_status") == config.delivered_status)
            .where(purchased >= F.lit(f"{config.first_day} 00:00:00").cast(ts_type))
            .where(purchased < F.lit(f"{config.day_after_last} 00:00:00").cast(ts_type))
            .select("order_id", "customer_id", week_start(purchased).alias("week")))


def bucket_of(value: str, buckets: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The bucket whose members contain the value, null when there is none.

    A configured mapping is an expression rather than a join: the planner then still
    knows the size of the table it is applied to, and broadcasts it only when small.
    """
    (first, members), *others = buckets
    bucket = F.when(F.col(value).isin(list(members)), first)
    for name, members in others:
        bucket = bucket.when(F.col(value).isin(list(members)), name)
    return bucket


def with_product_group(frame: DataFrame, raw: RawTables, config: NetworkConfig) -> DataFrame:
    """Category name -> planning group; null or unmapped categories get the fallback."""
    group = bucket_of("product_category_name_english", config.group_categories)
    return (frame.join(raw.category_translation, "product_category_name", "left")
            .withColumn("product_group", F.coalesce(group, F.lit(config.fallback_group)))
            .drop("product_category_name", "product_category_name_english"))


def product_groups(raw: RawTables, config: NetworkConfig) -> DataFrame:
    return with_product_group(raw.products, raw, config).select("product_id", "product_group")


def build_order_items(raw: RawTables, config: NetworkConfig) -> DataFrame:
    """Delivered items with customer state, hub and product group, in the window.

    Orders are cut down and matched with customers before they meet the much larger
    item table. Sellers and products are joined as they are stored, without hints:
    Spark knows their sizes and broadcasts them below its threshold; beyond it the
    joins are shuffled and adaptive execution splits hot sellers and products.
    """
    customers = raw.customers.where(F.col("customer_state").isin(list(config.states)))
    sellers = (raw.sellers.withColumn("hub", bucket_of("seller_state", config.hub_members))
               .where(F.col("hub").isNotNull()))
    orders = (delivered_orders(raw, config)
              .join(customers.select("customer_id", "customer_state"), "customer_id")
              .select("order_id", "customer_state", "week"))
    items = (raw.order_items
             .join(orders, "order_id")
             .join(sellers.select("seller_id", "hub"), "seller_id")
             .join(raw.products, "product_id", "left"))
    return with_product_group(items, raw, config).select(*ITEM_KEY, *ITEM_COLUMNS)


def lane_weeks(items: DataFrame) -> DataFrame:
    """Items and freight per week, state, hub and group.

    The one pass over the items that demand, flows, capacities and the freight line
    are all computed from. It aggregates map-side, and its size is bounded by
    weeks x states x hubs x groups whatever the number of items.
    """
    return items.groupBy("week", "customer_state", "hub", "product_group").agg(
        F.count("*").alias("items"), F.sum("freight_value").alias("freight"))


def preparation_summary(lanes: DataFrame) -> DataFrame:
    """Items per hub, and the number of items and distinct weeks over all hubs."""
    weeks = lanes.groupBy("hub", "week").agg(F.sum("items").alias("items"))
    total = weeks.agg(F.lit("all").alias("hub"), F.sum("items").alias("items"),
                      F.countDistinct("week").alias("weeks"))
    return weeks.groupBy("hub").agg(F.sum("items").alias("items"),
                                    F.count("*").alias("weeks")).unionByName(total)
