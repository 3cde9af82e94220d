"""Star-schema parquet tables seen as the seven raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hubloom.operators.costs import known_distance
from hubloom.sources.raw import RawTables
from hubloom.sources.small import literal_table

# Part types and their English category names.
PART_TYPE_ENGLISH = {
    "STANDARD": "standard",
    "SMALL": "small",
    "ECONOMY": "economy",
    "LARGE": "large",
    "MEDIUM": "medium",
    "PROMO": "promo",
}

# The columns in use; a declared schema saves a pass over the file footers.
STAR_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE",
}

# Freight is not part of the star schema: a flat fee, a fee per unit of quantity
# and a fee per kilometre between the customer's state and the hub.
FREIGHT_FLAT, FREIGHT_PER_UNIT, FREIGHT_PER_KM = 10.0, 0.2, 0.01


def read_star_tables(spark: SparkSession, folder: str) -> RawTables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")

    nation = table("nation")
    customers = table("customer").join(nation, F.expr("c_nationkey = n_nationkey"))
    sellers = table("supplier").join(nation, F.expr("s_nationkey = n_nationkey"))
    return RawTables(
        # one synthetic point per customer, scattered around its nation's anchor
        geolocation=customers.selectExpr(
            "n_name AS geolocation_state",
            "-30.0D + 1.5D * ((c_nationkey * 7) % 25) + ((c_custkey % 101) - 50) / 100.0D"
            " AS geolocation_lat",
            "-65.0D + 1.2D * ((c_nationkey * 11) % 25) + (((c_custkey * 37) % 101) - 50) / 100.0D"
            " AS geolocation_lng"),
        orders=table("orders").selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS order_status",
            "o_orderdate AS order_purchase_timestamp"),
        order_items=table("lineitem").selectExpr(
            "l_orderkey AS order_id", "l_linenumber AS order_item_id", "l_partkey AS product_id",
            "l_suppkey AS seller_id", "l_extendedprice AS price",
            f"{FREIGHT_FLAT}D + {FREIGHT_PER_UNIT}D * l_quantity AS freight_value"),
        customers=customers.selectExpr("c_custkey AS customer_id", "n_name AS customer_state"),
        sellers=sellers.selectExpr("s_suppkey AS seller_id", "n_name AS seller_state"),
        products=table("part").selectExpr("p_partkey AS product_id", "p_type AS product_category_name"),
        category_translation=literal_table(
            spark,
            product_category_name=list(PART_TYPE_ENGLISH),
            product_category_name_english=list(PART_TYPE_ENGLISH.values())),
    )


def add_distance_freight(items: DataFrame, distances: DataFrame) -> DataFrame:
    """Add the distance fee to each item's freight.

    `distances` holds one row per configured (state, hub), which bounds the broadcast.
    """
    fee = distances.select("customer_state", "hub",
                           (F.lit(FREIGHT_PER_KM) * F.col("km")).alias("distance_fee"))
    fee_of = known_distance(F.col("customer_state"), F.col("distance_fee"))
    return (items.join(F.broadcast(fee), ["customer_state", "hub"], "left")
            .withColumn("freight_value", F.col("freight_value") + fee_of)
            .select(items.columns))
