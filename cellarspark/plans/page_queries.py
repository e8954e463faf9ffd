"""Queries of pages: products, meta tags in any order, result links, regions, joined texts; and of cells of recognition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import labels as L
from cellarspark.functions import pages as P
from cellarspark.functions import text as T
from cellarspark.operators import rerank
from cellarspark.operators.products import page_products
from cellarspark.plans import sqltext as S
from cellarspark.plans.index_queries import _FIRST, catalog
from cellarspark.plans.ranking_queries import _REQ, requests
from cellarspark.plans.registry import query
from cellarspark.sources.files import public_view
from cellarspark.sources.tables import table

_FLAT = "trim(regexp_replace(replace(coalesce({0}, ''), '\"', ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


def _markup(spark: SparkSession, folder: str) -> DataFrame:
    """(cache_id, html): pages with data scripts, meta tags in either order and result links, made from the cached cells."""
    text = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit(""))
    odd = F.col("cache_id") % 2 == 1
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("name"), F.struct(F.col("winery").alias("name")).alias("brand"), F.concat(F.lit("46-"), F.col("cache_id").cast("string")).alias("gtin13"), F.col("grape").alias("description")))
    nested = F.concat(F.lit('{"@context": "x", "@graph": [{"@type": "WebPage"}, '), node, F.lit("]}"))
    script = F.concat(F.lit('<script type="application/ld+json">'), F.replace(F.when(odd, nested).otherwise(F.concat(F.lit("["), node, F.lit("]"))), F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    meta = F.when(odd, F.concat(F.lit('<meta property="og:title" content="'), text("name"), F.lit('">'))).otherwise(F.concat(F.lit('<META content="'), text("name"), F.lit('" property = "og:title" />')))
    packed = F.concat(F.lit('<a rel="x" class="r result__a" href="//search.example/l/?uddg='), F.url_encode(F.coalesce("source", F.lit(""))), F.lit('&amp;rut=1"><b>'), text("name"), F.lit("</b></a>"))
    plain = F.concat(F.lit('<a href="'), F.coalesce("source", F.lit("")), F.lit('" class="result__a">'), text("name"), F.lit('</a><a class="result__a" href="https://search.example/y">own</a>'))
    html = F.concat(F.lit("<html><head>"), meta, script, F.lit("</head><body>"), F.when(odd, packed).otherwise(plain), F.lit("</body></html>"))
    return table(spark, folder, "external_cache").select("cache_id", html.alias("html"))


@query("SELECT cache_id, '46' || cache_id AS gtin, length(regexp_replace(coalesce(name, ''), '\\s', '', 'g')) > 0 AS named FROM external_cache WHERE status = 'found'")
def page_product(spark: SparkSession, folder: str) -> DataFrame:
    """The product each found page describes in its data scripts, however deep."""
    found = table(spark, folder, "external_cache").where("status = 'found'").select("cache_id")
    products = page_products(_markup(spark, folder), "cache_id", "html").join(found, "cache_id", "left_semi")
    return products.select("cache_id", "gtin", (F.length("name") > 0).alias("named"))


@query(f"SELECT cache_id, {_FLAT.format('name')} AS title FROM external_cache")
def page_meta_any(spark: SparkSession, folder: str) -> DataFrame:
    """Titles from meta tags whose attributes stand in any order."""
    return _markup(spark, folder).select("cache_id", P.meta_any("html", "property", "og:title").alias("title"))


@query("SELECT cache_id, source AS url FROM external_cache WHERE starts_with(coalesce(source, ''), 'http')")
def result_links(spark: SparkSession, folder: str) -> DataFrame:
    """Where the result links of pages lead: redirects unwrapped, links within the search host left out."""
    links = _markup(spark, folder).select("cache_id", F.explode(P.anchors("html", "result__a")).alias("a"))
    return links.select("cache_id", P.target_url(F.col("a.href"), "search.example", "/l/", "uddg").alias("url")).where("url <> ''")


@query("SELECT cache_id, trim(regexp_replace(regexp_extract(coalesce(text, ''), '(?i)(?:регион|region)\\s*[:\\-–]?\\s*([A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё \\-]{2,40})', 1), '\\s+', ' ', 'g')) AS region FROM external_cache")
def page_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The region that each page's text names after the word for it."""
    return table(spark, folder, "external_cache").select("cache_id", P.region_named("text").alias("region"))


_PARTS = "list_filter(list_transform([name, winery, grape, query], lambda x: trim(regexp_replace(coalesce(x, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')), lambda x: x <> '')"


@query(f"SELECT cache_id, substr(array_to_string(list_filter({_PARTS}, lambda x, i: list_position({_PARTS}, x) = i), ' '), 1, 120) AS body FROM external_cache")
def page_body(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct parts of a page's profile in one text of at most 120 characters."""
    return table(spark, folder, "external_cache").select("cache_id", P.joined_text([F.col(c) for c in ("name", "winery", "grape", "query")], 120).alias("body"))


_CELLS = ("name", "winery", "grape", "category", "region")


@query(f"""
SELECT r.trace_id AS request, CASE WHEN c.slug IS NOT NULL AND coalesce(final_score, 0) >= 0.5 THEN 'found' WHEN c.slug IS NOT NULL THEN 'not_in_catalog' ELSE 'not_found' END AS status, CASE WHEN coalesce(final_score, 0) >= 0.5 THEN c.slug END AS slug, round(coalesce(final_score, 0), 4) AS confidence,
  {', '.join(f"CASE WHEN c.slug IS NOT NULL AND coalesce(final_score, 0) >= 0.5 THEN coalesce(c.{x}, '') ELSE '' END AS {x}" for x in _CELLS)} FROM {_REQ} r LEFT JOIN {_FIRST} c ON c.slug = r.winner_slug""")
def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answer to each request: a found card with its cells, or none of them."""
    last = requests(spark, folder).select(F.col("trace_id").alias("request"), "winner_slug", F.coalesce("final_score", F.lit(0.0)).alias("confidence"))
    j = last.join(catalog(spark, folder).select("slug", *_CELLS), F.col("winner_slug") == F.col("slug"), "left")
    status = F.when(F.col("slug").isNotNull() & (F.col("confidence") >= 0.5), "found").when(F.col("slug").isNotNull(), "not_in_catalog").otherwise("no_card")
    return public_view(j.withColumn("status", status), list(_CELLS))


def _telling(c: Column | str) -> Column:
    return F.array_distinct(F.filter(T.tokens(c), lambda t: ~T.is_generic(t)))


_TELL = "list_distinct(list_filter({0}, lambda t: NOT {1}))"


def _told(c: str) -> str:
    return _TELL.format(S.tokens(c), S.generic("t"))


_FEATURES = f"""(SELECT r.trace_id, n.n.slug AS slug, coalesce(n.n.visual, 0) AS visual, len(list_intersect(t, {_told('c.grape')})) AS grapes, len(list_intersect(t, list_distinct(list_concat({_told('c.name')}, {_told('c.winery')})))) AS names, list_has_any(t, {_told('c.winery')})::INT AS maker, len(t) - len(list_intersect(t, {_told('c.grape')})) AS missing, (n.n.slug = r.winner_slug)::INT AS label
FROM (SELECT trace_id, winner_slug, {_told('ocr')} AS t FROM {_REQ} WHERE winner_slug IS NOT NULL) r JOIN (SELECT trace_id, unnest(neighbors) AS n FROM {_REQ}) n ON n.trace_id = r.trace_id JOIN {_FIRST} c ON c.slug = n.n.slug)"""


@query(f"SELECT trace_id, slug, visual, grapes, names, maker, missing, label FROM {_FEATURES}")
def candidate_features(spark: SparkSession, folder: str) -> DataFrame:
    """What a learned head reads of each candidate: its score and how many of the text's words are its grapes, names, maker or none."""
    t = requests(spark, folder).where("winner_slug is not null").select("trace_id", "winner_slug", _telling("ocr").alias("t"), F.explode("neighbors").alias("n"))
    c = catalog(spark, folder).select("slug", _telling("grape").alias("grape"), _telling("winery").alias("winery"), F.array_distinct(F.concat(_telling("name"), _telling("winery"))).alias("named"))
    j = t.select("trace_id", "winner_slug", "t", F.col("n.slug").alias("slug"), F.coalesce("n.visual", F.lit(0.0)).alias("visual")).join(c, "slug")
    shared = lambda x: F.size(F.array_intersect("t", x))
    return j.select("trace_id", "slug", "visual", shared("grape").alias("grapes"), shared("named").alias("names"), F.arrays_overlap("t", "winery").cast("int").alias("maker"), (F.size("t") - shared("grape")).alias("missing"), (F.col("slug") == F.col("winner_slug")).cast("int").alias("label"))


@query()
def learned_head(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy on held-out requests of a logistic head trained on the others, and the share of the larger class."""
    rows = candidate_features(spark, folder).select("trace_id", *[F.col(c).cast("double").alias(c) for c in ("visual", "grapes", "names", "maker", "missing")], F.lit(0.0).alias("cosine"), "label")
    held = F.pmod(F.xxhash64("trace_id"), F.lit(5)) == 0
    head = rerank.fit_logistic(rows.where(~held), ["visual", "grapes", "names", "maker", "missing", "cosine"], "label")
    scored = rows.where(held).select("label", (rerank.logistic([F.col(c) for c in ("visual", "grapes", "names", "maker", "missing", "cosine")], head) >= 0.5).cast("int").alias("said"))
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("label")).cast("int")).alias("accuracy"), F.greatest(F.avg("label"), 1 - F.avg("label")).alias("larger_class"))


@query(f"SELECT row_idx, coalesce(TRY_CAST(sugar AS DOUBLE), 0) AS sugar, coalesce(TRY_CAST({S.cell('taste')} AS DOUBLE), -1) AS taste FROM strapi_output0709")
def cell_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Cells as numbers, a default where they are none."""
    return table(spark, folder, "strapi_output0709").select("row_idx", L.number("sugar").alias("sugar"), L.number("taste", -1.0).alias("taste"))
