"""Queries of the engine's core: names, plans and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.operators import packed
from cellarspark.plans.registry import query
from cellarspark.sources.tables import table

def grape_fields(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_id, grape) of both tables that have the field."""
    catalog = table(spark, folder, "strapi_output0709").select(F.lit("strapi_output0709").alias("src"), F.col("row_idx").alias("row_id"), "grape")
    cache = table(spark, folder, "external_cache").select(F.lit("external_cache").alias("src"), F.col("cache_id").alias("row_id"), "grape")
    return catalog.unionByName(cache)


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of every grape field that holds two or more."""
    values = packed.split_values(grape_fields(spark, folder), ["src", "row_id"], "grape")
    return values.where("n_values >= 2").select("src", "row_id", "pos", "part_text")
