"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.sources.ship import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; columns are pruned and filters pushed by the callers' plans."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cell(column: Column | str) -> Column:
    """A string cell without its missing markers: NULL and 'nan' (any case) become '', others lose the blanks at their ends."""
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(c.isNull() | (F.lower(bare) == "nan"), F.lit("")).otherwise(bare)
