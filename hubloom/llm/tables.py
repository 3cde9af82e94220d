"""Reading the shared tables, and writing intermediate ones where every executor sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubloom.session import materialise, store

# White space that separates words in the word-counting operators; everything else is a word.
WORDS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` written once to the shared checkpoint folder; later reads survive lost executors.

    In at most `most` partitions, where given: a table of few rows then isn't as many tiny files
    as there are shuffle partitions, and nor are the shuffles that begin at it.
    """
    return materialise(df if most is None else df.coalesce(most))


def word_count(text: str | Column) -> Column:
    """Number of words of a text column as long; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORDS)).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared checkpoint folder and read again."""
    return store(df)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
