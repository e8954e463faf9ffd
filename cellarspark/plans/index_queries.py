"""Queries of the catalog, its indexes and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import index as I
from cellarspark.plans import sqltext as S
from cellarspark.plans.lineage import cut
from cellarspark.plans.registry import query
from cellarspark.sources.tables import cell, table

_FIRST = f"(SELECT * FROM strapi_output0709 WHERE {S.cell('slug')} <> '' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY row_idx) = 1)"
FIELDS = {"name": "name", "grape": "grape", "winery": "winery", "region": "region"}


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One row a slug, the first by row_idx."""
    return I.first_rows(table(spark, folder, "strapi_output0709"), "slug", "row_idx")


@query(f"SELECT row_idx, slug, {S.cell('name')} AS name, {S.cell('winery')} AS winery, {S.cell('category')} AS category FROM {_FIRST}")
def catalog_first_row(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog with its first row of each slug and clean cells."""
    return catalog(spark, folder).select("row_idx", "slug", *[cell(c).alias(c) for c in ("name", "winery", "category")])


@query(f"SELECT row_idx, coalesce(nullif({S.cell('taste')}, ''), nullif({S.cell('sugar')}, ''), nullif({S.cell('food')}, ''), '') AS note FROM strapi_output0709")
def catalog_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """The first of several cells that is not missing."""
    alternatives = [F.nullif(cell(c), F.lit("")) for c in ("taste", "sugar", "food")]
    return table(spark, folder, "strapi_output0709").select("row_idx", F.coalesce(*alternatives, F.lit("")).alias("note"))


@query(f"SELECT row_idx, slug FROM {_FIRST} WHERE contains(lower(concat_ws(' ', {S.cell('name')}, {S.cell('winery')}, {S.cell('grape')})), 'калдорна')")
def catalog_substring(spark: SparkSession, folder: str) -> DataFrame:
    """Cards whose name, maker or grape contains a text, whatever its case."""
    blob = F.lower(F.concat_ws(" ", cell("name"), cell("winery"), cell("grape")))
    return catalog(spark, folder).where(F.contains(blob, F.lit("калдорна"))).select("row_idx", "slug")


_LOW = "trim(regexp_replace(translate(lower(coalesce({0}, '')), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"
_BLOB = ", ".join("nullif(" + _LOW.format(c) + ", '')" for c in ("name", "category", "color", "region", "grape", "winery", "description"))


@query(f"SELECT row_idx, concat_ws(' ', {_BLOB}) AS blob FROM {_FIRST}")
def catalog_blob(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each card for a text encoder: seven normalised cells."""
    parts = [F.nullif(T.lower_normalize(c), F.lit("")) for c in ("name", "category", "color", "region", "grape", "winery", "description")]
    return catalog(spark, folder).select("row_idx", F.concat_ws(" ", *parts).alias("blob"))


@query(f"SELECT {S.cell('winery')} AS winery, {S.cell('category')} AS category, count(*) AS n FROM strapi_output0709 GROUP BY 1, 2 ORDER BY n DESC, winery, category LIMIT 20")
def group_profile_top20(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty largest groups of maker and category."""
    groups = table(spark, folder, "strapi_output0709").groupBy(cell("winery").alias("winery"), cell("category").alias("category")).agg(F.count("*").alias("n"))
    return groups.orderBy(F.desc("n"), "winery", "category").limit(20)


_POST = " UNION ".join(f"SELECT '{k}' AS kind, unnest({S.tokens(c)}) AS token, slug FROM {_FIRST}" for k, c in FIELDS.items())


@query(f"SELECT kind, token, count(*) AS owners FROM ({_POST}) GROUP BY 1, 2")
def posting_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many cards own each token of each field."""
    return I.postings(catalog(spark, folder), FIELDS).groupBy("kind", "token").agg(F.count("*").alias("owners"))


_FREQ = f"(SELECT token, count(DISTINCT slug) AS df, ln(((SELECT greatest(count(*), 1) FROM {_FIRST}) + 1) / (count(DISTINCT slug) + 1)) + 1 AS idf FROM ({_POST}) GROUP BY token)"


@query(f"SELECT token, df, round(idf, 6) AS idf FROM {_FREQ}")
def token_df_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and weight of each token."""
    return I.token_frequencies(catalog(spark, folder), FIELDS).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT token, count(*) AS owners FROM ({_POST}) WHERE kind = 'winery' AND length(token) >= 4 AND token NOT IN ({S.quoted(W.NAME_STOP)}) AND NOT regexp_full_match(translate(token, 'ОI', '01'), '[0-9]{{4}}') GROUP BY 1")
def winery_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Maker tokens that are no filler, with the cards that own them."""
    post = I.postings(catalog(spark, folder), {"winery": "winery"})
    return post.where((F.length("token") >= 4) & ~T.is_generic("token")).groupBy("token").agg(F.count("*").alias("owners"))


@query(f"SELECT token, df, df / (SELECT greatest(count(*), 1) FROM {_FIRST}) <= 0.08 AS distinctive FROM {_FREQ}")
def distinctive_name(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that at most eight in a hundred cards own."""
    cards = catalog(spark, folder)
    total = F.broadcast(cards.agg(F.greatest(F.count("*"), F.lit(1)).alias("total")))  # one row
    return I.token_frequencies(cards, FIELDS).crossJoin(total).select("token", "df", (F.col("df") / F.col("total") <= 0.08).alias("distinctive"))


@query(f"""
WITH asked AS (SELECT DISTINCT trace_id, unnest({S.tokens('ocr')}) AS token FROM recognition_trace),
named AS (SELECT DISTINCT unnest({S.tokens('name')}) AS token, slug FROM {_FIRST}),
freq AS (SELECT token, count(*) AS df, ln(((SELECT greatest(count(*), 1) FROM {_FIRST}) + 1) / (count(*) + 1)) + 1 AS idf FROM named GROUP BY 1)
SELECT trace_id, slug, round(sum(idf), 6) AS score, count(*) AS hits FROM asked JOIN named USING (token) JOIN freq USING (token) WHERE df <= 12 AND length(token) >= 5 GROUP BY 1, 2""")
def name_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that share rare label tokens with each observation, by summed weight."""
    cards = catalog(spark, folder)
    post, freq = I.postings(cards, {"name": "name"}), I.token_frequencies(cards, {"name": "name"})
    asked = table(spark, folder, "recognition_trace").select("trace_id", F.explode(T.tokens("ocr")).alias("token"))
    return I.rare_scores(asked, post, freq, "trace_id", "slug").select("trace_id", "slug", F.round("score", 6).alias("score"), "hits")


@query(f"""
WITH named AS (SELECT DISTINCT unnest({S.tokens('name')}) AS token, slug, {S.cell('winery')} AS winery FROM {_FIRST})
SELECT token, count(*) AS owners, min(winery) AS winery FROM named WHERE token NOT IN ({S.quoted(W.NAME_STOP + W.LINE_FILLERS)}) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 80 AND min(winery) = max(winery) AND min(winery) <> ''""")
def owner_division(spark: SparkSession, folder: str) -> DataFrame:
    """Label tokens of which all owners belong to one maker: the set of owners divides into that maker's cards."""
    named = catalog(spark, folder).select(F.explode(T.tokens("name")).alias("token"), "slug", cell("winery").alias("winery")).distinct()
    sized = named.where(~F.col("token").isin(W.NAME_STOP + W.LINE_FILLERS)).groupBy("token").agg(F.count("*").alias("owners"), F.min("winery").alias("winery"), F.max("winery").alias("other"))
    return sized.where(F.col("owners").between(2, 80) & (F.col("winery") == F.col("other")) & (F.col("winery") != "")).select("token", "owners", "winery")


_G = f"list_sort(list_distinct({S.tokens('grape')}))"


@query(f"""
WITH g AS (SELECT {_G} AS t FROM {_FIRST}), l AS (SELECT t, unnest(t) AS a FROM g), p AS (SELECT a, unnest(t) AS b FROM l)
SELECT a, b, count(*) AS cards FROM p WHERE a < b GROUP BY 1, 2""")
def posting_and(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that carry both tokens, for every two grape tokens that meet; the pairs of one card are few."""
    t = catalog(spark, folder).select(F.array_distinct(T.tokens("grape")).alias("t"))
    pairs = t.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cards"))


@query(f"""
WITH g AS (SELECT DISTINCT unnest({S.tokens('grape')}) AS token, slug FROM {_FIRST}),
a AS (SELECT slug FROM g WHERE token = 'ПЬЕРЛАН'), b AS (SELECT slug FROM g WHERE token = 'СОЛЬМЕРА'), c AS (SELECT slug FROM g WHERE token = 'НЕТТАКОГО'),
ab AS (SELECT slug FROM a INTERSECT SELECT slug FROM b), s2 AS (SELECT slug FROM ab UNION SELECT slug FROM a WHERE NOT EXISTS (SELECT 1 FROM ab)),
abc AS (SELECT slug FROM s2 INTERSECT SELECT slug FROM c)
SELECT slug FROM abc UNION SELECT slug FROM s2 WHERE NOT EXISTS (SELECT 1 FROM abc)""")
def posting_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Cards with as many of the asked grapes as can be had together, taken in order."""
    post = I.postings(catalog(spark, folder), {"grape": "grape"})
    return I.greedy_intersection(post, "slug", ["ПЬЕРЛАН", "СОЛЬМЕРА", "НЕТТАКОГО"])


@query("""
WITH l AS (SELECT winner_slug, winner_slug AS slug, visual FROM recognition_trace UNION ALL SELECT winner_slug, n.slug, n.visual FROM (SELECT winner_slug, unnest(neighbors) AS n FROM recognition_trace))
SELECT winner_slug, slug, round(max(visual), 6) AS visual FROM l WHERE winner_slug IS NOT NULL AND slug IS NOT NULL GROUP BY 1, 2""")
def merge_max_union(spark: SparkSession, folder: str) -> DataFrame:
    """Leaders and neighbours in one list, with the best score of each."""
    t = table(spark, folder, "recognition_trace").where("winner_slug is not null")
    near = t.select("winner_slug", F.explode("neighbors").alias("n")).select("winner_slug", "n.slug", "n.visual")
    both = t.select("winner_slug", F.col("winner_slug").alias("slug"), "visual").unionByName(near)
    return both.where("slug is not null").groupBy("winner_slug", "slug").agg(F.round(F.max("visual"), 6).alias("visual"))


@query("SELECT trace_id, asked_at, logged_at, method, round(final_score, 6) AS final_score FROM recognition_trace QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY logged_at DESC) = 1")
def trace_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of each request."""
    t = table(spark, folder, "recognition_trace").groupBy("trace_id").agg(F.max(F.struct("logged_at", "asked_at", "method", "final_score")).alias("r"))
    return t.select("trace_id", "r.asked_at", "r.logged_at", "r.method", F.round("r.final_score", 6).alias("final_score"))


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS code, count(*) AS orders, min(o_orderkey) AS first_order FROM orders GROUP BY 1 HAVING length(lpad(CAST(o_custkey AS VARCHAR), 8, '0')) IN (8, 12, 13, 14)")
def code_index(spark: SparkSession, folder: str) -> DataFrame:
    """Digit codes of an allowed length, with how many rows carry each and the first of them."""
    code = F.lpad(F.regexp_replace(F.col("o_custkey").cast("string"), "\\D", ""), 8, "0")
    return table(spark, folder, "orders").groupBy(code.alias("code")).agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order")).where(F.length("code").isin(8, 12, 13, 14))


@query(f"SELECT token, count(*) AS uses FROM (SELECT unnest({S.tokens('ocr')}) AS token FROM recognition_trace) WHERE token IN ({S.quoted(W.NAME_STOP)}) OR regexp_full_match(translate(token, 'ОI', '01'), '[0-9]{{4}}') GROUP BY 1")
def generic_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the observations that say nothing, with their uses."""
    t = table(spark, folder, "recognition_trace").select(F.explode(T.tokens("ocr")).alias("token"))
    return t.where(T.is_generic("token")).groupBy("token").agg(F.count("*").alias("uses"))


@query(f"""
WITH d AS (SELECT doc_id, list_distinct({S.tokens('text')}) AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS token FROM d),
f AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM p WHERE token IN ('ВИШНИ', 'МИНДАЛЯ', 'КРЫЖОВНИКА') GROUP BY 1)
SELECT doc_id, round(sum(idf), 6) AS score FROM p JOIN f USING (token) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""")
def text_ask_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten texts that match an ask best by summed token weight."""
    docs = table(spark, folder, "documents")
    asked = ["ВИШНИ", "МИНДАЛЯ", "КРЫЖОВНИКА"]
    # whatever a token is joined and folded from, its letters stand in the text in this order: most texts end here
    letters = F.replace(F.translate(T.normalize("text"), W.LOOK_LATIN, W.LOOK_CYRILLIC), F.lit(" "), F.lit(""))
    near = docs.select("doc_id", "text", letters.alias("letters")).where(" or ".join(f"contains(letters, '{w}')" for w in asked))
    hits = F.array_intersect(T.tokens("text"), F.array(*map(F.lit, asked)))
    p = cut(near.select("doc_id", F.explode(hits).alias("token")))
    total = F.broadcast(docs.agg(F.count("*").alias("total")))  # one row
    f = F.broadcast(p.groupBy("token").agg(F.count("*").alias("df")).crossJoin(total).select("token", I.idf(F.col("df"), F.col("total")).alias("idf")))  # one row a token asked for
    return p.join(f, "token").groupBy("doc_id").agg(F.round(F.sum("idf"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)
