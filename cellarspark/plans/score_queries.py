"""Queries of score aggregation, fusion and near-equal candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.operators import rerank
from cellarspark.plans.registry import query
from cellarspark.sources.tables import table

_S = "list_sort(list_filter(list_transform(neighbors, lambda n: n.visual), lambda x: x IS NOT NULL), 'DESC')"


def _scores() -> Column:
    return F.filter(F.transform("neighbors", lambda n: n["visual"]), lambda x: x.isNotNull())


@query(f"SELECT trace_id, logged_at, round(CASE WHEN len({_S}) > 0 THEN least(1, list_sum({_S}[1:4]) / len({_S}[1:4]) / 2.5) ELSE 0 END, 6) AS score FROM recognition_trace")
def field_score_top4(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the four best matches of each request."""
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.round(rerank.field_score(_scores()), 6).alias("score"))


@query(f"SELECT trace_id, logged_at, round(CASE WHEN len({_S}) >= 3 THEN 0.60 * {_S}[1] + 0.25 * {_S}[2] + 0.15 * {_S}[3] WHEN len({_S}) = 2 THEN 0.70 * {_S}[1] + 0.30 * {_S}[2] WHEN len({_S}) = 1 THEN {_S}[1] ELSE 0 END, 6) AS score FROM recognition_trace")
def legacy_top3_weight(spark: SparkSession, folder: str) -> DataFrame:
    """The three best matches of each request by falling weights."""
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.round(rerank.top3_score(_scores()), 6).alias("score"))


_T, _V = "coalesce(final_score, 0)", "coalesce(visual, 0)"


_FUSED = f"SELECT trace_id, logged_at, round(least(1, greatest(0, CASE WHEN len(neighbors) = 0 THEN 0.65 * {_V} + 0.35 * {_T} + 0.10 * {_T} WHEN len(neighbors) = 1 THEN 0.25 * {_V} + 0.75 * {_T} ELSE {_V} END)), 6) AS fused FROM recognition_trace"


@query(_FUSED)
def fused_score(spark: SparkSession, folder: str) -> DataFrame:
    """Text and visual score in one, by how exclusive the request's candidates are."""
    n = F.size("neighbors")
    fused = F.round(rerank.fuse_exact(F.col("final_score"), F.col("visual"), n <= 1, F.when(n == 1, 2).otherwise(1)), 6)
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", fused.alias("fused"))


_NEAR = "(SELECT trace_id, logged_at, final_score, len(neighbors) AS size, unnest(neighbors) AS n FROM recognition_trace)"


@query(f"SELECT trace_id, logged_at, n.slug AS slug, round(least(1, greatest(0, CASE WHEN size = 1 THEN 0.25 * coalesce(n.visual, 0) + 0.75 * {_T} ELSE coalesce(n.visual, 0) END)), 6) AS fused FROM {_NEAR}")
def fused_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The fused score of every neighbour of every request."""
    n = table(spark, folder, "recognition_trace").select("trace_id", "logged_at", "final_score", F.size("neighbors").alias("size"), F.explode("neighbors").alias("n"))
    return n.select("trace_id", "logged_at", "n.slug", F.round(rerank.fuse_exact(F.col("final_score"), F.col("n.visual"), F.col("size") == 1, F.lit(2)), 6).alias("fused"))


@query()
def near_duplicate_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """The first four vectors of each label that are unlike each other."""
    e = table(spark, folder, "embeddings")
    return rerank.drop_near_equal(e, "label", "vec_id", "embedding", 4).select("label", F.explode("kept").alias("vec_id"))


@query("SELECT count(*) AS asked, avg(CAST(coalesce(final_score, 0) >= 0.9 AS INT)) AS sure, round(avg(coalesce(visual, 0)), 6) AS visual, method FROM recognition_trace GROUP BY method")
def method_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Requests, sure ones and mean score by method."""
    t = table(spark, folder, "recognition_trace").groupBy("method")
    return t.agg(F.count("*").alias("asked"), F.avg((F.coalesce("final_score", F.lit(0.0)) >= 0.9).cast("int")).alias("sure"), F.round(F.avg(F.coalesce("visual", F.lit(0.0))), 6).alias("visual"))
