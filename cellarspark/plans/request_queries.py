"""Queries that follow a request from its text to candidates: lexicon, cleaning, shortlist, asks, lookup texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import index as I
from cellarspark.plans import sqltext as S
from cellarspark.plans.index_queries import _FIRST, catalog
from cellarspark.plans.registry import query
from cellarspark.sources.tables import table

#: of kinds that share a token the one that is worth most
KINDS = {"grape": 4, "winery": 3, "name": 2, "region": 1}
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KINDS.items()) + " END"
_TOKENS = " UNION ".join(f"SELECT DISTINCT unnest({S.tokens(c)}) AS token, '{k}' AS kind FROM {_FIRST}" for k, c in (("grape", "grape"), ("winery", "winery"), ("name", "name"), ("region", "region")))
_LEXICON = f"(SELECT token, arg_max(kind, {_RANK}) AS kind FROM ({_TOKENS}) WHERE token NOT IN ({S.quoted(W.NAME_STOP)}) GROUP BY 1)"


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(token, kind) of all catalog tokens that are no filler, each under its best kind."""
    post = I.postings(catalog(spark, folder), {k: k for k in KINDS}).select("token", "kind").distinct()
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    return post.where(~F.col("token").isin(W.NAME_STOP)).groupBy("token").agg(F.max_by("kind", rank).alias("kind"))


@query(f"SELECT token, kind FROM {_LEXICON}")
def lexicon_build(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon of the catalog."""
    return lexicon(spark, folder)


_SEEN = f"(SELECT trace_id, logged_at, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT trace_id, logged_at, {S.tokens('ocr')} AS t FROM recognition_trace))"


def seen_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(trace_id, logged_at, pos, token) of all observed texts."""
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.posexplode(T.tokens("ocr")).alias("pos", "token"))


@query(f"""
WITH h AS (SELECT trace_id, logged_at, token, kind, min(pos) AS pos FROM {_SEEN} JOIN {_LEXICON} USING (token) GROUP BY 1, 2, 3, 4)
SELECT trace_id, logged_at, string_agg(token, ' ' ORDER BY pos) AS cleaned, count(*) AS kept, count(*) FILTER (kind = 'grape') AS grapes FROM h GROUP BY 1, 2""")
def lexicon_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Observed texts reduced to their known tokens, each once, in order."""
    hits = seen_tokens(spark, folder).join(lexicon(spark, folder), "token").groupBy("trace_id", "logged_at", "token", "kind").agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return hits.groupBy("trace_id", "logged_at").agg(F.array_join(ordered, " ").alias("cleaned"), F.count("*").alias("kept"), F.count_if(F.col("kind") == "grape").alias("grapes"))


@query(f"""
WITH named AS (SELECT DISTINCT unnest({S.tokens('name')}) AS token, slug FROM {_FIRST}), rare AS (SELECT token FROM named GROUP BY 1 HAVING count(*) <= 12 AND length(token) >= 5),
k AS (SELECT s.trace_id, s.logged_at, count(*) FILTER (l.kind = 'grape') AS g, count(*) FILTER (l.kind = 'winery') AS w, count(r.token) AS n, count(l.token) AS known FROM {_SEEN} s LEFT JOIN {_LEXICON} l USING (token) LEFT JOIN rare r USING (token) GROUP BY 1, 2)
SELECT trace_id, logged_at, CASE WHEN n > 0 THEN 'name' WHEN g > 0 AND w > 0 THEN 'grape and maker' WHEN g > 0 THEN 'grape' WHEN w > 0 THEN 'maker' WHEN known > 0 THEN 'weak' ELSE 'unknown' END AS reason FROM k""")
def shortlist_reason(spark: SparkSession, folder: str) -> DataFrame:
    """What a request's candidates can rest on, strongest evidence first."""
    named = I.postings(catalog(spark, folder), {"name": "name"})
    rare = named.groupBy("token").agg(F.count("*").alias("df")).where((F.col("df") <= 12) & (F.length("token") >= 5)).select("token", F.lit(True).alias("rare"))
    j = seen_tokens(spark, folder).join(lexicon(spark, folder), "token", "left").join(rare, "token", "left")
    k = j.groupBy("trace_id", "logged_at").agg(F.count_if(F.col("kind") == "grape").alias("g"), F.count_if(F.col("kind") == "winery").alias("w"), F.count("rare").alias("n"), F.count("kind").alias("known"))
    g, w = F.col("g") > 0, F.col("w") > 0
    reason = F.when(F.col("n") > 0, "name").when(g & w, "grape and maker").when(g, "grape").when(w, "maker").when(F.col("known") > 0, "weak").otherwise("unknown")
    return k.select("trace_id", "logged_at", reason.alias("reason"))


@query(f"""
WITH asked AS (SELECT DISTINCT cache_id, unnest({S.tokens('query')}) AS token FROM external_cache), named AS (SELECT DISTINCT unnest({S.tokens('name')}) AS token, slug FROM {_FIRST}),
freq AS (SELECT token, count(*) AS df, ln(((SELECT greatest(count(*), 1) FROM {_FIRST}) + 1) / (count(*) + 1)) + 1 AS idf FROM named GROUP BY 1),
s AS (SELECT cache_id, slug, round(sum(idf), 6) AS score FROM asked JOIN named USING (token) JOIN freq USING (token) WHERE df <= 12 AND length(token) >= 5 GROUP BY 1, 2)
SELECT cache_id, slug, score, row_number() OVER (PARTITION BY cache_id ORDER BY score DESC, slug) AS place FROM s QUALIFY row_number() OVER (PARTITION BY cache_id ORDER BY score DESC, slug) <= 4""")
def ask_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The four cards that answer each ask best."""
    cards = catalog(spark, folder)
    asked = table(spark, folder, "external_cache").select("cache_id", F.explode(T.tokens("query")).alias("token"))
    scored = I.rare_scores(asked, I.postings(cards, {"name": "name"}), I.token_frequencies(cards, {"name": "name"}), "cache_id", "slug").withColumn("score", F.round("score", 6))
    return I.top_per(scored, "cache_id", [F.desc("score"), F.asc("slug")], 4).select("cache_id", "slug", "score", F.col("place").cast("long").alias("place"))


_KEY = f"lower(translate(t, '{W.LOOK_CYRILLIC}', '{W.LOOK_LATIN}'))"
_WORDS = f"list_filter({S.tokens('ocr')}, lambda t: NOT list_contains([{S.quoted(W.NAME_STOP)}], t) AND NOT regexp_full_match(translate(t, 'ОI', '01'), '[0-9]{{4}}'))"


@query(f"""
WITH w AS (SELECT trace_id, logged_at, {_WORDS} AS t FROM recognition_trace), k AS (SELECT *, list_transform(t, lambda t: {_KEY}) AS k FROM w)
SELECT trace_id, logged_at, substr('вино ' || lower(array_to_string(list_filter(t, lambda x, i: list_position(k, k[i]) = i)[1:6], ' ')), 1, 300) AS ask FROM k""")
def web_query(spark: SparkSession, folder: str) -> DataFrame:
    """The lookup text of each request: its first six telling words, look-alike spellings of one word once."""
    telling = F.filter(T.tokens("ocr"), lambda t: ~T.is_generic(t))
    keyed = F.transform(telling, lambda t: F.struct(t.alias("t"), F.lower(F.translate(t, W.LOOK_CYRILLIC, W.LOOK_LATIN)).alias("k")))
    start = F.expr("cast(array() as array<struct<t:string,k:string>>)")
    once = F.aggregate(keyed, start, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(F.struct(x["t"].alias("t"), x["k"].alias("k"))))))
    words = F.transform(F.slice(once, 1, 6), lambda x: x["t"])
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.substring(F.concat(F.lit("вино "), F.lower(F.array_join(words, " "))), 1, 300).alias("ask"))
