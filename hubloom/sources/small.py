"""Small literal tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def literal_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of configuration values; a LocalRelation with exact statistics."""
    return spark.createDataFrame(pa.table(columns))
