"""The seven raw tables and their readers."""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class RawTables:
    """Raw inputs, one DataFrame per table.

    geolocation: geolocation_state, geolocation_lat, geolocation_lng
    orders: order_id, customer_id, order_status, order_purchase_timestamp
    order_items: order_id, order_item_id, product_id, seller_id, price, freight_value
    customers: customer_id, customer_state
    sellers: seller_id, seller_state
    products: product_id, product_category_name
    category_translation: product_category_name, product_category_name_english

    rejected: rows that the reader has set aside (raw_table, file, problem, row); none where
    the source can have no malformed rows or they are treated otherwise
    """

    geolocation: DataFrame
    orders: DataFrame
    order_items: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    category_translation: DataFrame
    rejected: DataFrame | None = None


# File names and columns of the public data, as they are spelled there.
# Full file layouts: a CSV schema has to name every column in file order, and
# Spark then parses only the ones a query uses.
_STRING, _DOUBLE, _INT, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

CSV_LAYOUT: dict[str, tuple[str, list[tuple[str, T.DataType]]]] = {
    "geolocation": ("*geolocation_dataset.csv", [
        ("geolocation_zip_code_prefix", _STRING), ("geolocation_lat", _DOUBLE),
        ("geolocation_lng", _DOUBLE), ("geolocation_city", _STRING),
        ("geolocation_state", _STRING)]),
    "orders": ("*orders_dataset.csv", [
        ("order_id", _STRING), ("customer_id", _STRING), ("order_status", _STRING),
        ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
        ("order_delivered_carrier_date", _TS), ("order_delivered_customer_date", _TS),
        ("order_estimated_delivery_date", _TS)]),
    "order_items": ("*order_items_dataset.csv", [
        ("order_id", _STRING), ("order_item_id", _INT), ("product_id", _STRING),
        ("seller_id", _STRING), ("shipping_limit_date", _TS), ("price", _DOUBLE),
        ("freight_value", _DOUBLE)]),
    "customers": ("*customers_dataset.csv", [
        ("customer_id", _STRING), ("customer_unique_id", _STRING),
        ("customer_zip_code_prefix", _STRING), ("customer_city", _STRING),
        ("customer_state", _STRING)]),
    "sellers": ("*sellers_dataset.csv", [
        ("seller_id", _STRING), ("seller_zip_code_prefix", _STRING),
        ("seller_city", _STRING), ("seller_state", _STRING)]),
    "products": ("*products_dataset.csv", [
        ("product_id", _STRING), ("product_category_name", _STRING),
        ("product_name_lenght", _STRING), ("product_description_lenght", _STRING),
        ("product_photos_qty", _STRING), ("product_weight_g", _STRING),
        ("product_length_cm", _STRING), ("product_height_cm", _STRING),
        ("product_width_cm", _STRING)]),
    "category_translation": ("*category_name_translation.csv", [
        ("product_category_name", _STRING), ("product_category_name_english", _STRING)]),
}

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


# What becomes of rows that don't fit the layout.
MALFORMED = ("error", "reject", "null")
REJECTED = "raw_table STRING, file STRING, problem STRING, row STRING"


def _parsed(name: str, kind: T.DataType) -> Column:
    """A field's value in its type; null where it can't be read."""
    if kind == _STRING:
        return F.col(name)
    if kind == _TS:
        return F.try_to_timestamp(name, F.lit(TIMESTAMP_FORMAT))
    return F.col(name).try_cast(kind)


def read_checked(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A raw CSV table with typed columns, and for each row: problem (null if none), file, row.

    A row is malformed if it has another number of fields than the layout or a typed field
    that isn't empty and can't be read. Fields are read as text and parsed by expressions, so
    the answer doesn't depend on which columns a query goes on to use. A header that does not
    match the expected layout is an error.
    """
    files, fields = CSV_LAYOUT[table]
    names = [name for name, _ in fields]
    schema = T.StructType([T.StructField(name, _STRING) for name in [*names, "_row"]])
    rows = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("quote", '"').option("escape", '"').option("columnPruning", False)
            .option("columnNameOfCorruptRecord", "_row").csv(f"{folder.rstrip('/')}/{files}"))
    unread = [F.when(F.col(n).isNotNull() & _parsed(n, t).isNull(), F.concat(F.lit(f"{n}: "), F.col(n)))
              for n, t in fields if t != _STRING]
    # The length keeps a field in the scan: Spark reads no row text on its own.
    fields_differ = F.col("_row").isNotNull() | (F.coalesce(F.length(names[0]), F.lit(0)) < 0)
    problem = F.concat_ws("; ", F.when(fields_differ, F.lit("number of fields")), *unread)
    return rows.select(
        *[_parsed(n, t).alias(n) for n, t in fields], F.nullif(problem, F.lit("")).alias("problem"),
        F.col("_metadata.file_path").alias("file"),
        F.coalesce("_row", F.concat_ws(",", *[F.coalesce(n, F.lit("")) for n in names])).alias("row"))


def read_raw_csv(spark: SparkSession, folder: str, malformed: str = "error") -> RawTables:
    """Read the raw CSV files of `folder` with typed columns.

    Malformed rows (see `read_checked`) are an error that names the file and the field; with
    "reject" they are left out of the tables and listed in `rejected`; with "null" they stay,
    and fields that can't be read are null.
    """
    if malformed not in MALFORMED:
        raise ValueError(f"malformed must be one of {MALFORMED}")

    def read(table: str) -> DataFrame:
        rows = read_checked(spark, folder, table)
        if malformed == "reject":
            rows = rows.where("problem IS NULL")
        if malformed == "error":
            message = F.concat(F.lit("malformed row in "), "file", F.lit(" ("), "problem", F.lit("): "), "row")
            rows = rows.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(message).cast("boolean")))
        return rows.drop("problem", "file", "row")

    rejected = reduce(DataFrame.unionByName, [
        read_checked(spark, folder, table).where("problem IS NOT NULL").select(
            F.lit(table).alias("raw_table"), "file", "problem", "row") for table in CSV_LAYOUT])
    return RawTables(**{table: read(table) for table in CSV_LAYOUT}, rejected=rejected if malformed == "reject" else None)


def table_counts(raw: RawTables) -> DataFrame:
    """Rows of each raw table, and how many more have been rejected."""
    counts = reduce(DataFrame.unionByName, [
        getattr(raw, table).agg(F.lit(table).alias("raw_table"), F.count("*").alias("rows"), F.lit(0).cast("long").alias("rejected"))
        for table in CSV_LAYOUT])
    if raw.rejected is None:
        return counts
    bad = raw.rejected.groupBy("raw_table").agg(F.lit(0).cast("long").alias("rows"), F.count("*").alias("rejected"))
    return counts.unionByName(bad).groupBy("raw_table").agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"))


def rejected_by_file(raw: RawTables) -> DataFrame:
    """Rejected rows of each file, by table."""
    return raw.rejected.groupBy("raw_table", "file").agg(F.count("*").alias("rejected"))


def read_raw_parquet(spark: SparkSession, folder: str) -> RawTables:
    """Read the same tables from parquet folders named after the tables."""
    return RawTables(**{
        table: spark.read.parquet(f"{folder.rstrip('/')}/{table}") for table in CSV_LAYOUT})
