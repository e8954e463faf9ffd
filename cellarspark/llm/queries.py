"""Queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.llm import boilerplate, canonical, linkage, lookalike, mixing, mojibake, packing, quality, tokens
from cellarspark.operators.packed import split_values
from cellarspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    """Register a plan under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _found_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "external_cache").where("status = 'found'")


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the main body of every page."""
    return boilerplate.main_lines(_found_pages(spark, folder), "cache_id", "text", ["name", "winery", "grape", "color", "region"], "source")


def _page_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "external_cache").select("cache_id", "text", "name")


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of which any part was garbled."""
    return mojibake.repair_fields(_page_fields(spark, folder), "cache_id", ["text", "name"]).where("garbled").select("cache_id", "field")


@query
def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled fields with their restored text, and whether anything was lost for good."""
    return mojibake.repair_fields(_page_fields(spark, folder), "cache_id", ["text", "name"]).where("garbled").select("cache_id", "field", "restored", "lost")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "strapi_output0709").select(F.lit("strapi_output0709").alias("src"), F.col("row_idx").alias("row_id"), F.lit("name").alias("field"), F.col("name").alias("text"))
    cache = table(spark, folder, "external_cache")
    names = cache.select(F.lit("external_cache").alias("src"), F.col("cache_id").alias("row_id"), F.lit("name").alias("field"), F.col("name").alias("text"))
    asks = cache.select(F.lit("external_cache").alias("src"), F.col("cache_id").alias("row_id"), F.lit("query").alias("field"), F.col("query").alias("text"))
    return catalog.unionByName(names).unionByName(asks)


@query
def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every label and query in one form."""
    return lookalike.unify(_labels(spark, folder), ["src", "row_id", "field"], "text").select("src", "row_id", "field", "fixed", "changed")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with a character that must change; names that are garbled (P3) are left out."""
    changed = lookalike.unify(_labels(spark, folder), ["src", "row_id", "field"], "text").where("changed")
    counts = mojibake.fit_bigrams(table(spark, folder, "external_cache"), ["name", "query"])
    return mojibake.without_garbled(changed, "text", counts, F.col("field") == "name").select("src", "row_id", "field")


def _free_values(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "strapi_output0709").select(F.lit("strapi_output0709").alias("src"), F.col("row_idx").alias("row_id"), "grape")
    cache = table(spark, folder, "external_cache")
    fields = catalog.unionByName(cache.select(F.lit("external_cache").alias("src"), F.col("cache_id").alias("row_id"), "grape"))
    grapes = split_values(fields, ["src", "row_id"], "grape").select("src", "row_id", F.lit("grape").alias("field"), "pos", F.col("part_text").alias("text"))
    region = F.trim("region")
    regions = cache.where((region != "") & (F.lower(region) != "nan")).select(F.lit("external_cache").alias("src"), F.col("cache_id").alias("row_id"), F.lit("region").alias("field"), F.lit(1).alias("pos"), F.col("region").alias("text"))
    return grapes.unionByName(regions)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are no canonical name, with the entry each means or 0."""
    mapped = canonical.map_values(_free_values(spark, folder), table(spark, folder, "lexicon"), ["src", "row_id", "field", "pos"], "field", "text")
    return mapped.where("not is_canonical").select("src", "row_id", "field", "pos", "ref_id")


@query
def p6_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report of values that mean no entry: each spelling with its number of uses."""
    mapped = canonical.map_values(_free_values(spark, folder), table(spark, folder, "lexicon"), ["src", "row_id", "field", "pos"], "field", "text")
    return mapped.where("ref_id = 0").groupBy("field", "text").agg(F.count("*").alias("uses"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), ["doc_id", "source"], "text")


@query
def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or piece of a text, for each capacity."""
    return packing.fill_containers(_sizes(spark, folder), table(spark, folder, "pack_capacity"), "doc_id")


@query
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    boxes = p7_containers(spark, folder).groupBy("capacity_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"))
    return boxes.groupBy("capacity_id", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.avg(F.col("tokens") / F.col("capacity_tokens")).alias("mean_fill"))


@query
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts drawn with their number of uses."""
    return mixing.draw(_sizes(spark, folder), table(spark, folder, "mix_target"), "doc_id")


@query
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares really reached."""
    targets = table(spark, folder, "mix_target")
    return mixing.shares(mixing.draw(_sizes(spark, folder), targets, "doc_id"), targets)


def _documents(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "common_word")


@query
def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every text."""
    return quality.document_statistics(*_documents(spark, folder)).withColumnRenamed("id", "doc_id")


@query
def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The outlier score of every text."""
    return quality.outlier_scores(*_documents(spark, folder)).select(F.col("id").alias("doc_id"), "lang", "score")


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are no natural prose, with their form."""
    return quality.unlike_prose(*_documents(spark, folder)).select(F.col("id").alias("doc_id"), "form")


@query
def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """The best card of each page with score, gap, tests and confidence."""
    return linkage.link(_found_pages(spark, folder), table(spark, folder, "strapi_output0709"))


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages about one wine of the catalog, with its card."""
    return p2_links(spark, folder).where(f"mutual and fits and confidence >= {linkage.CONFIDENT}").select("row_idx", "cache_id")
