"""Sinks for the reporting database."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The reporting tables and their SQL types.
REPORTING_TYPES: dict[str, dict[str, str]] = {
    "order_items": {
        "week": "DATE", "customer_state": "VARCHAR(2)", "hub": "VARCHAR(20)",
        "product_group": "VARCHAR(20)", "price": "NUMERIC", "freight_value": "NUMERIC"},
    "weekly_demand": {
        "week": "DATE", "customer_state": "VARCHAR(2)", "product_group": "VARCHAR(20)",
        "demand": "INTEGER"},
}

_CASTS = {"DATE": T.DateType(), "INTEGER": T.IntegerType(), "NUMERIC": T.DecimalType(38, 18)}


def reporting_columns(df: DataFrame, table: str) -> DataFrame:
    """The columns of a reporting table, in order and in its types."""
    return df.select(*[
        F.col(c).cast(_CASTS[sql_type]).alias(c) if sql_type in _CASTS else F.col(c)
        for c, sql_type in REPORTING_TYPES[table].items()])


def jdbc_options(url: str, table: str, partitions: int = 16, batch: int = 10_000,
                 **extra: str) -> dict[str, str]:
    """Options of a replacing load: the table is recreated with the reporting types."""
    types = REPORTING_TYPES[table]
    return {
        "url": url, "dbtable": table,
        "createTableColumnTypes": ", ".join(f"{c} {t}" for c, t in types.items()
                                            if t.startswith("VARCHAR")),
        "numPartitions": str(partitions), "batchsize": str(batch), **extra}


def load_reporting_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Replace a reporting table over JDBC, in parallel from the executors."""
    (reporting_columns(df, table).write.format("jdbc").mode("overwrite")
     .options(**jdbc_options(url, table, **options)).save())
