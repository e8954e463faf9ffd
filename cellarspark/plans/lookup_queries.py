"""Queries of the lookup cache, page extraction, evaluation and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarspark.functions import pages as P
from cellarspark.operators import lookup_cache as C
from cellarspark.operators.index import top_per
from cellarspark.plans.registry import query
from cellarspark.sources.tables import table
from cellarspark.streaming import lookups

#: the moment at which the cache is judged; fixed, so that results repeat
NOW = 1_735_689_600.0
_BODY = ("query", "status", "name", "grape")


_LATEST = "SELECT cache_key, cached_at, cache_id, status FROM external_cache QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC NULLS LAST, cache_id DESC) = 1"


@query(_LATEST)
def cache_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last entry of each lookup."""
    return C.latest(table(spark, folder, "external_cache").select("cache_key", "cached_at", "cache_id", "status"), "cache_key", "cached_at", "cache_id")


_ALIVE = f"coalesce(cached_at, 0) > 0 AND {NOW} - cached_at <= coalesce(negative_ttl, {C.NEGATIVE_TTL})"


@query(f"SELECT cache_id, coalesce(status = 'found' OR (status IN ('not_found', 'empty', 'non_html') AND {_ALIVE}), false) AS usable FROM external_cache")
def cache_ttl_usable(spark: SparkSession, folder: str) -> DataFrame:
    """Which entries may still answer."""
    return table(spark, folder, "external_cache").select("cache_id", C.usable(NOW).alias("usable"))


@query("""
SELECT cache_key, coalesce(arg_min(grape, {'a': coalesce(cached_at, 0), 'b': cache_id}) FILTER (coalesce(grape, '') <> ''), '') AS grape,
  coalesce(arg_min(region, {'a': coalesce(cached_at, 0), 'b': cache_id}) FILTER (coalesce(region, '') <> ''), '') AS region,
  coalesce(arg_min(winery, {'a': coalesce(cached_at, 0), 'b': cache_id}) FILTER (coalesce(winery, '') <> ''), '') AS winery
FROM external_cache GROUP BY 1""")
def first_nonempty_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """A profile of each lookup: the first filled value of each attribute, oldest entry first."""
    t = table(spark, folder, "external_cache").withColumn("at", F.coalesce("cached_at", F.lit(0.0)))
    return C.first_filled(t, "cache_key", ["at", "cache_id"], ["grape", "region", "winery"])


@query("""
SELECT cache_id, CASE WHEN coalesce(sweetness, '') <> '' THEN sweetness ELSE coalesce(taste, '') END AS sweetness, CASE WHEN status = 'found' THEN 'page' WHEN status IN ('empty', 'not_found') THEN 'nothing found' WHEN status = 'non_html' THEN 'no page' ELSE 'failed' END
  || CASE WHEN coalesce(where_found, '') <> '' THEN ', ' || where_found ELSE '' END AS reason FROM external_cache""")
def profile_gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Sweetness filled from taste where missing, and the reason of each result in words."""
    s = F.col("status")
    reason = F.concat_ws(", ", F.when(s == "found", "page").when(s.isin("empty", "not_found"), "nothing found").when(s == "non_html", "no page").otherwise("failed"), F.nullif("where_found", F.lit("")))
    filled = F.when(F.coalesce("sweetness", F.lit("")) != "", F.col("sweetness")).otherwise(F.coalesce("taste", F.lit("")))
    return table(spark, folder, "external_cache").select("cache_id", filled.alias("sweetness"), reason.alias("reason"))


@query(_LATEST)
def cache_stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The cache after its entries came as a stream."""
    return lookups.cache_from_stream(spark, folder)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2")
def event_stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of a stream of events, each once."""
    return lookups.event_counts(spark, folder)


_HTML = "'<html><head><title>' || replace(replace(coalesce(name, ''), '&', '&amp;'), '<', '&lt;') || '</title><meta name=\"description\" content=\"' || replace(coalesce(grape, ''), '\"', '&quot;') || '\"></head><body><script>var a = 1;</script><p>' || replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') || '</p><a href=\"' || coalesce(source, '') || '\">x</a></body></html>'"


def _html(spark: SparkSession, folder: str) -> DataFrame:
    """Pages rebuilt from the cached cells."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = [F.lit("<html><head><title>"), esc("name"), F.lit('</title><meta name="description" content="'), F.replace(F.coalesce("grape", F.lit("")), F.lit('"'), F.lit("&quot;")), F.lit('"></head><body><script>var a = 1;</script><p>'), esc("text"), F.lit('</p><a href="'), F.coalesce("source", F.lit("")), F.lit('">x</a></body></html>')]
    return table(spark, folder, "external_cache").select("cache_id", F.concat(*parts).alias("html"))


@query("SELECT cache_id, coalesce(name, '') AS title FROM external_cache")
def page_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of pages."""
    return _html(spark, folder).select("cache_id", P.title("html").alias("title"))


@query("SELECT cache_id, coalesce(grape, '') AS description FROM external_cache")
def page_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions of pages."""
    return _html(spark, folder).select("cache_id", P.meta("html", "description").alias("description"))


@query("SELECT cache_id, trim(regexp_replace(coalesce(name, '') || ' ' || coalesce(text, '') || ' x', '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS shown FROM external_cache")
def page_visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader of the page sees."""
    return _html(spark, folder).select("cache_id", P.visible_text("html").alias("shown"))


@query("SELECT cache_id, coalesce(source, '') AS link FROM external_cache WHERE coalesce(source, '') <> ''")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of pages, one a row."""
    return _html(spark, folder).select("cache_id", F.explode(P.links("html")).alias("link"))


@query("SELECT regexp_extract(source, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, count(DISTINCT regexp_extract(source, '([^/]+)/?$', 1)) AS leaves FROM external_cache WHERE coalesce(source, '') <> '' GROUP BY 1")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by host, with their different last path parts."""
    t = table(spark, folder, "external_cache").where(F.coalesce("source", F.lit("")) != "")
    return t.groupBy(F.parse_url("source", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("source", "([^/]+)/?$", 1)).alias("leaves"))


@query("SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """A number in each event's JSON, summed by kind."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


_RANK = "(SELECT list_position(list_transform(neighbors, lambda n: n.slug), winner_slug) AS place FROM recognition_trace WHERE winner_slug IS NOT NULL)"


@query(f"SELECT count(*) AS asked, round(avg(CAST(coalesce(place, 0) = 1 AS INT)), 6) AS top1, round(avg(CAST(coalesce(place, 0) BETWEEN 1 AND 5 AS INT)), 6) AS top5, round(avg(coalesce(1.0 / nullif(place, 0), 0)), 6) AS mrr FROM {_RANK}")
def eval_topk_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """How often the leader is first, and among the first five, of the neighbours; mean reciprocal rank."""
    place = F.array_position(F.transform("neighbors", lambda n: n["slug"]), F.col("winner_slug"))
    t = table(spark, folder, "recognition_trace").where("winner_slug is not null").select(F.coalesce(place, F.lit(0)).alias("place"))
    return t.agg(F.count("*").alias("asked"), F.round(F.avg((F.col("place") == 1).cast("int")), 6).alias("top1"), F.round(F.avg(F.col("place").between(1, 5).cast("int")), 6).alias("top5"), F.round(F.avg(F.when(F.col("place") > 0, 1 / F.col("place")).otherwise(0.0)), 6).alias("mrr"))


@query("""
WITH g AS (SELECT unnest(generate_series(0, 10)) AS step), s AS (SELECT step, CAST(status_ok AS INT) AS ok, CAST(step / 10.0 * v + (1 - step / 10.0) * f >= 0.5 AS INT) AS said
  FROM g, (SELECT coalesce(visual, 0) AS v, coalesce(final_score, 0) AS f, winner_slug IS NOT NULL AS status_ok FROM recognition_trace))
SELECT step, round(avg(CAST(ok = said AS INT)), 6) AS accuracy FROM s GROUP BY 1""")
def eval_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of a threshold on the weighted score for each of eleven weights."""
    t = table(spark, folder, "recognition_trace").select(F.coalesce("visual", F.lit(0.0)).alias("v"), F.coalesce("final_score", F.lit(0.0)).alias("f"), F.col("winner_slug").isNotNull().alias("ok"))
    each = t.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(10))))
    w = F.col("step") / F.lit(10.0)
    return each.groupBy("step").agg(F.round(F.avg((F.col("ok") == (w * F.col("v") + (1 - w) * F.col("f") >= 0.5)).cast("int")), 6).alias("accuracy"))


@query("SELECT method, round(quantile_cont(visual, 0.5), 6) AS median, round(avg(visual), 6) AS mean, count(*) AS n FROM recognition_trace GROUP BY 1")
def eval_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Median and mean score by method."""
    t = table(spark, folder, "recognition_trace").groupBy("method")
    return t.agg(F.round(F.percentile("visual", F.lit(0.5)), 6).alias("median"), F.round(F.avg("visual"), 6).alias("mean"), F.count("*").alias("n"))


@query("""
WITH v AS (SELECT l_returnflag, l_quantity AS x, count(*) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM v)
SELECT l_returnflag, min(x) AS median FROM c WHERE 2 * upto >= total GROUP BY 1""")
def weighted_median(spark: SparkSession, folder: str) -> DataFrame:
    """The value at which half of the weight is reached; equal values are summed before they are ordered."""
    v = table(spark, folder, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("x")).agg(F.count("*").alias("w"))
    w = Window.partitionBy("l_returnflag")
    c = v.withColumn("upto", F.sum("w").over(w.orderBy("x"))).withColumn("total", F.sum("w").over(w))
    return c.where("2 * upto >= total").groupBy("l_returnflag").agg(F.min("x").alias("median"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events")
def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of each event's value, the one before and the one after it of the same user and kind."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(-1, 1)
    return table(spark, folder, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("smooth"))


_X = "greatest(least(a.l_quantity + 20, b.l_quantity + 20) - greatest(a.l_quantity, b.l_quantity), 0) * greatest(least(a.l_discount * 100 + 5, b.l_discount * 100 + 5) - greatest(a.l_discount * 100, b.l_discount * 100), 0)"


@query(f"SELECT a.l_orderkey AS box_set, a.l_linenumber AS i, b.l_linenumber AS j, round({_X} / (200 - {_X}), 6) AS iou FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE {_X} / (200 - {_X}) >= 0.3")
def box_iou_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping boxes of one set; a set has seven at most."""
    t = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("y"))
    a, b = t.alias("a"), t.alias("b")
    wide = F.greatest(F.least(F.col("a.l_quantity") + 20, F.col("b.l_quantity") + 20) - F.greatest("a.l_quantity", "b.l_quantity"), F.lit(0))
    high = F.greatest(F.least(F.col("a.y") + 5, F.col("b.y") + 5) - F.greatest("a.y", "b.y"), F.lit(0))
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    shared = wide * high
    return pairs.select(F.col("a.l_orderkey").alias("box_set"), F.col("a.l_linenumber").alias("i"), F.col("b.l_linenumber").alias("j"), F.round(shared / (200 - shared), 6).alias("iou"), (shared / (200 - shared)).alias("raw")).where("raw >= 0.3").drop("raw")


@query("""
WITH n AS (SELECT trace_id, logged_at, unnest(neighbors) AS n FROM recognition_trace), f AS (SELECT trace_id, logged_at, n.slug AS slug, n.visual AS visual, count(*) OVER (PARTITION BY trace_id, logged_at) AS size FROM n)
SELECT trace_id, logged_at, slug, round(visual, 6) AS visual, size FROM f QUALIFY row_number() OVER (PARTITION BY trace_id, logged_at ORDER BY visual DESC NULLS LAST, slug) <= 2""")
def diversity_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The two best different neighbours of each request."""
    t = table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.explode("neighbors").alias("n"), F.size("neighbors").alias("size")).select("trace_id", "logged_at", "n.slug", "n.visual", "size")
    top = top_per(t.withColumn("request", F.struct("trace_id", "logged_at")), "request", [F.desc_nulls_last("visual"), F.asc("slug")], 2)
    return top.select("trace_id", "logged_at", "slug", F.round("visual", 6).alias("visual"), F.col("size").cast("long").alias("size"))
