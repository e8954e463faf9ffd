"""Queries of label words: readings, colours, sweetness, grapes, and the signals of requests, pages and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import labels as L
from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import signals as G
from cellarspark.plans import sqltext as S
from cellarspark.plans.index_queries import _FIRST, catalog
from cellarspark.plans.match_queries import _WORDS, seen_words
from cellarspark.plans.lineage import cut
from cellarspark.plans.registry import query
from cellarspark.sources.tables import cell, table

_GRAPES = f"(SELECT DISTINCT unnest({S.tokens('grape')}) AS grape FROM {_FIRST})"
_LATIN = S.votes("word", S.ONLY_LATIN)
_CYR = S.votes("word", S.ONLY_CYRILLIC)
_VOWELS = S.votes("word", L.VOWELS)
_READABLE = f"(word = 'ДОЛИНА' OR (length(word) >= 4 AND regexp_full_match(word, '[A-ZА-Я]+') AND {_VOWELS} >= 1 AND (length(word) < 6 OR {_VOWELS} >= 2) AND NOT regexp_matches(word, '[^{L.VOWELS}]{{4,}}') AND NOT {S.generic('word')} AND NOT {S.near_filler('word')}))"
_ALIAS = W.CLIPPED_GRAPES | W.LATIN_GRAPES


def grapes(spark: SparkSession, folder: str) -> DataFrame:
    """(grape): the words of the catalog's grapes."""
    return cut(catalog(spark, folder).select(F.explode(T.tokens("grape")).alias("grape")).distinct())


@query(f"""
SELECT word, {S.brut('word')} AS brut, {S.repair('word')} AS repaired, {_READABLE} AS readable, CASE WHEN {_LATIN} > 0 AND {_CYR} = 0 THEN 'lat' ELSE 'cyr' END AS script,
  CASE WHEN {_CYR} <> {_LATIN} THEN {_LATIN} > {_CYR} ELSE {S.votes('word', W.LOOK_LATIN)} > {S.votes('word', W.LOOK_CYRILLIC)} END AS latin,
  CASE WHEN regexp_matches(word, '[{W.DISTINCT_LATIN}]') AND translate(word, '{W.LOOK_CYRILLIC}', '{W.LOOK_LATIN}') <> word THEN translate(word, '{W.LOOK_CYRILLIC}', '{W.LOOK_LATIN}') END AS latin_form,
  {S.shown('word')} AS shown, lower(translate(upper(word), '{W.LOOK_CYRILLIC}', '{W.LOOK_LATIN}')) AS twin,
  (NOT regexp_full_match(word, '[0-9]+') AND NOT {S.brut('word')} AND (word = 'ДОЛИНА' OR NOT {S.generic('word')})) AS asked,
  (word IN ({S.quoted(W.COMMON_GRAPES)}) OR coalesce({S.mapped('word', _ALIAS)} IN ({S.quoted(W.COMMON_GRAPES)}), false)) AS common_grape FROM {_WORDS}""")
def word_readings(spark: SparkSession, folder: str) -> DataFrame:
    """How every observed word can be read and whether it may be asked for."""
    w = F.col("word")
    words = seen_words(spark, folder)
    fillers = G.near_fillers(words).withColumn("filler", F.lit(True))
    return words.join(fillers, "word", "left").select(
        "word", L.brut_misread(w).alias("brut"), L.repair_reading(w).alias("repaired"), L.readable(w, F.coalesce("filler", F.lit(False))).alias("readable"), L.word_script(w).alias("script"), L.mostly_latin(w).alias("latin"), L.latin_reading(w).alias("latin_form"),
        L.shown_word(w).alias("shown"), L.twin_key(w).alias("twin"), L.asked_word(w).alias("asked"), L.common_grape(w).alias("common_grape"),
    )


@query(f"SELECT word, {S.colour('word', 'g.grape IS NOT NULL')} AS colour, {S.sweet('word')} AS sweetness FROM {_WORDS} LEFT JOIN {_GRAPES} g ON g.grape = word")
def word_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The colour and the sweetness that every observed word means."""
    return G.class_words(seen_words(spark, folder), grapes(spark, folder)).withColumnRenamed("sweet", "sweetness")


_STOP = S.quoted(W.GRAPE_STOP)


def resolved(words: str) -> str:
    """SQL of the grape of each word in the table `words`."""
    return f"""(WITH w AS (SELECT DISTINCT word FROM {words} WHERE word NOT IN ({_STOP})), g AS (SELECT grape FROM {_GRAPES}),
a AS (SELECT word, grape, 'alias' AS quality, 1 AS o FROM w JOIN g ON grape = {S.mapped('word', W.CLIPPED_GRAPES | W.LATIN_GRAPES)} WHERE grape NOT IN ({_STOP})),
p AS (SELECT word FROM w WHERE length(word) >= 4 AND NOT {S.near_filler('word')}),
e AS (SELECT word, grape, 'exact' AS quality, 2 AS o FROM p JOIN g ON grape = word),
x AS (SELECT word, min(grape) AS grape, 'prefix' AS quality, 3 AS o FROM p JOIN g ON length(word) >= 6 AND starts_with(grape, word) AND length(grape) > length(word) AND length(grape) - length(word) <= 4 AND grape NOT IN ({_STOP}) GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT word, grape, {S.ratio('word', 'grape')} AS score FROM p JOIN g ON length(word) >= 5 AND length(grape) >= 4 AND abs(length(grape) - length(word)) <= 2 AND grape NOT IN ({_STOP})),
r AS (SELECT word, grape, score, row_number() OVER (PARTITION BY word ORDER BY score DESC, grape) AS n FROM s WHERE score >= 0.9),
f AS (SELECT word, max(grape) FILTER (n = 1) AS grape, 'fuzzy' AS quality, 4 AS o FROM r GROUP BY 1 HAVING count(*) = 1 OR max(score) FILTER (n = 1) - max(score) FILTER (n = 2) >= 0.04)
SELECT word, arg_min(grape, o) AS grape, arg_min(quality, o) AS quality FROM (SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT * FROM x UNION ALL SELECT * FROM f) GROUP BY 1)"""


@query(f"SELECT word, grape, quality FROM {resolved(_WORDS)}")
def grape_words(spark: SparkSession, folder: str) -> DataFrame:
    """The grape of every observed word by its other spellings, itself, a unique beginning or the clearly nearest grape."""
    return G.resolve_grapes(seen_words(spark, folder), grapes(spark, folder))


def _sql_signals(source: str, key: str, text: str) -> str:
    """SQL of (key, colour, sweetness, grapes, tastes) of the texts of a table."""
    return f"""(WITH src AS (SELECT {key}, {text} AS said FROM {source}), t AS (SELECT {key}, generate_subscripts(x, 1) AS pos, unnest(x) AS word FROM (SELECT {key}, {S.tokens('said')} AS x FROM src)),
v AS (SELECT DISTINCT word FROM t), c AS (SELECT v.word, {S.colour('v.word', 'g.grape IS NOT NULL')} AS colour, {S.sweet('v.word')} AS sweet, r.grape AS grape FROM v LEFT JOIN {_GRAPES} g ON g.grape = v.word LEFT JOIN {resolved('v')} r ON r.word = v.word),
k AS (SELECT {key}, min(colour) AS lo, max(colour) AS hi, list_distinct(list(sweet) FILTER (sweet IS NOT NULL)) AS sweets FROM t JOIN c USING (word) GROUP BY ALL),
g AS (SELECT {key}, list(grape ORDER BY pos) AS grapes FROM (SELECT {key}, grape, min(pos) AS pos FROM t JOIN c USING (word) WHERE grape IS NOT NULL GROUP BY ALL) GROUP BY ALL),
s AS (SELECT *, {S.sweet_text("replace(said, '-', ' ')")} AS told, {S.stems('said', W.TASTE_STEMS)} AS tastes FROM src)
SELECT s.*, CASE WHEN k.lo = k.hi THEN k.lo END AS colour, list_distinct(list_concat(coalesce(k.sweets, []), CASE WHEN told IS NULL THEN [] ELSE [told] END)) AS sweets, coalesce(g.grapes, []) AS grapes FROM s LEFT JOIN k USING ({key}) LEFT JOIN g USING ({key}))"""


_FLAT = "CASE WHEN len(sweets) = 1 THEN sweets[1] END AS sweetness, array_to_string(grapes, ' ') AS grapes, array_to_string(tastes, ' ') AS tastes"


@query(f"SELECT trace_id, colour, {_FLAT} FROM {_sql_signals('(SELECT trace_id, arg_max(ocr, logged_at) AS ocr FROM recognition_trace GROUP BY 1)', 'trace_id', 'ocr')}")
def request_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Colour, sweetness, grapes and tastes that each request's text names; several colours or sweetnesses are none."""
    t = table(spark, folder, "recognition_trace").groupBy("trace_id").agg(F.max_by("ocr", "logged_at").alias("ocr"))
    return _flat(G.text_signals(t, "trace_id", F.col("ocr"), grapes(spark, folder)), "trace_id")


def _flat(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "colour", "sweetness", F.array_join("grapes", " ").alias("grapes"), F.array_join("tastes", " ").alias("tastes"))


_PAGE_TEXT = "concat_ws(' ', nullif(grape, ''), nullif(color, ''), nullif(coalesce(nullif(sweetness, ''), taste), ''), nullif(taste, ''), nullif(region, ''), nullif(name, ''), nullif(text, ''))"


def page_text() -> Column:
    """What a page says about its wine, in one text."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = [blank("grape"), blank("color"), F.nullif(F.coalesce(blank("sweetness"), F.col("taste")), F.lit("")), *map(blank, ("taste", "region", "name", "text"))]
    return F.concat_ws(" ", *parts)


_ASKED = "(SELECT * FROM external_cache WHERE status = 'found' AND cache_id % 20 = 0)"


@query(f"SELECT cache_id, colour, {_FLAT}, (SELECT array_to_string(list_sort(list_distinct(list_filter({S.tokens('e.winery')}, lambda t: length(t) >= 4 AND NOT {S.generic('t')}))), ' ') FROM external_cache e WHERE e.cache_id = q.cache_id) AS brands FROM {_sql_signals(_ASKED, 'cache_id', _PAGE_TEXT)} q")
def profile_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The signals of every twentieth found page, with its maker's words."""
    pages = table(spark, folder, "external_cache").where("status = 'found' and cache_id % 20 = 0")
    out = G.profile_signals(pages, "cache_id", page_text(), grapes(spark, folder))
    return _flat(out, "cache_id").join(out.select("cache_id", F.array_join(F.array_sort("brands"), " ").alias("brands")), "cache_id")


_COARSE = (
    "CASE WHEN contains({n}, 'ОРАНЖ') THEN 'orange' WHEN contains({n}, 'РОЗОВ') THEN 'rose' WHEN contains({n}, 'КРАСН') THEN 'red' WHEN contains(' ' || {n}, ' БЕЛ') THEN 'white' "
    "WHEN regexp_matches({s}, 'ORANZHEVOE|ORANGE') THEN 'orange' WHEN regexp_matches({s}, 'ROZOVOE|ROSE') THEN 'rose' WHEN contains({s}, 'KRASNOE') THEN 'red' WHEN contains({s}, 'BELOE') THEN 'white' END"
).format(n=S.normalize("category"), s=S.normalize("replace(slug, '-', ' ')"))
_NAMED = "concat_ws(' ', nullif(name, ''), nullif(slug, ''))"
_CARDS = f"""(WITH t AS (SELECT row_idx, generate_subscripts(x, 1) AS pos, unnest(x) AS word FROM (SELECT row_idx, {S.tokens('grape')} AS x FROM {_FIRST})), v AS (SELECT DISTINCT word FROM t),
g AS (SELECT row_idx, list(grape ORDER BY pos) AS grapes FROM (SELECT row_idx, grape, min(pos) AS pos FROM t JOIN {resolved('v')} USING (word) GROUP BY ALL) GROUP BY 1)
SELECT row_idx, slug, name, winery, region, description, {_COARSE} AS colour, coalesce({S.sweet_text("replace(" + _NAMED + ", '-', ' ')")}, {S.sweet_text("replace(description, '-', ' ')")}) AS sweetness, coalesce(grapes, []) AS grapes,
  list_distinct({S.tokens('winery')}) AS makers, list_distinct({S.tokens('region')}) AS regions, {S.stems('description', W.TASTE_STEMS)} AS tastes, list_distinct({S.tokens("concat_ws(' ', nullif(name, ''), nullif(replace(slug, '-', ' '), ''), nullif(winery, ''))")}) AS brands
FROM {_FIRST} LEFT JOIN g USING (row_idx))"""


@query(f"SELECT row_idx, colour, sweetness, array_to_string(grapes, ' ') AS grapes, array_to_string(tastes, ' ') AS tastes, array_to_string(list_sort(makers), ' ') AS makers, array_to_string(list_sort(regions), ' ') AS regions, array_to_string(list_sort(brands), ' ') AS brands FROM {_CARDS}")
def card_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The attributes of every card as a request's signals meet them."""
    sorted_ = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return G.card_signals(catalog(spark, folder)).select("row_idx", "colour", "sweetness", F.array_join("grapes", " ").alias("grapes"), F.array_join("tastes", " ").alias("tastes"), *map(sorted_, ("makers", "regions", "brands")))


_STYLE = f"(SELECT trace_id, logged_at, {S.tokens('ocr')} AS t FROM recognition_trace)"
_CLOSE = "(abs(length(t) - {n}) <= 1 AND {r} >= 0.8)"
_ULTRA = f"(t IN ('ULTRA', 'УЛЬТРА') OR {_CLOSE.format(n=6, r=S.ratio('t', repr('УЛЬТРА')))})"
_ORANGE = _CLOSE.format(n=5, r=S.ratio("t", repr("ОРАНЖ")))
_LINE = f"flatten(list_transform(t, lambda t: [CASE WHEN {_ULTRA} THEN 'Ultra' END, CASE WHEN t IN ('CUVEE', 'CUVE', 'КЮВЕ') THEN 'кюве' END]))"
_COLOURS = f"list_transform(t, lambda t: coalesce({S.mapped('t', W.COLOUR_ASKED)}, CASE WHEN {_ORANGE} THEN 'оранж' END))"
_SWEETS = f"list_transform(t, lambda t: CASE WHEN {S.brut('t')} THEN 'брют' ELSE {S.mapped('t', W.SWEET_ASKED)} END)"


@query(f"""
WITH k AS (SELECT trace_id, logged_at, list_filter(list_concat({_LINE}, {_COLOURS}, {_SWEETS}), lambda x: x IS NOT NULL) AS s FROM {_STYLE})
SELECT trace_id, logged_at, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' ') AS style FROM k""")
def style_words(spark: SparkSession, folder: str) -> DataFrame:
    """Line, colour and sweetness words of each request in the order of a lookup."""
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.array_join(L.style_words(T.tokens("ocr")), " ").alias("style"))


_PLAIN = "regexp_extract_all(translate(upper(coalesce({0}, '')), 'Ё', 'Е'), '[A-ZА-Я]{{3,}}')"
_CONTENT = f"list_filter({_PLAIN.format('query')}, lambda w: length(w) >= 4 AND NOT list_contains([{S.quoted(W.ASK_STOP)}], w))"


@query(f"""
SELECT cache_id, array_to_string(list_filter({_CONTENT}, lambda w, i: list_position({_CONTENT}, w) = i), ' ') AS content, length(trim(regexp_replace(coalesce(query, ''), '\\s+', ' ', 'g'))) < 3 AS too_short,
  array_to_string(list_transform({S.stems('text', [s for s, _ in W.FOOD_STEMS])}, lambda s: {S.mapped('s', dict(W.FOOD_STEMS))}), ' ') AS foods,
  array_to_string(list_transform({S.stems('text', W.TASTE_STEMS)}, lambda s: {S.mapped('s', dict(zip(W.TASTE_STEMS, W.TASTE_WORDS)))})[1:5], ', ') AS tastes,
  len(list_intersect(list_distinct(list_transform({_CONTENT}, lambda w: substr(w, 1, 3))), list_transform({_PLAIN.format("concat_ws(' ', name, grape, text)")}, lambda w: substr(w, 1, 3)))) AS overlap,
  trim(regexp_replace(concat_ws(' ', nullif(trim(grape), ''), nullif(trim(color), ''), nullif(trim(coalesce(nullif(sweetness, ''), taste)), ''), nullif(trim(taste), '')), ' +', ' ', 'g')) AS blob FROM external_cache""")
def ask_words(spark: SparkSession, folder: str) -> DataFrame:
    """What an ask says: its content words, the foods and tastes of its page, and how many of its words the page shares."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    blob = F.concat_ws(" ", part(F.col("grape")), part(F.col("color")), part(F.coalesce(F.nullif(F.col("sweetness"), F.lit("")), F.col("taste"))), part(F.col("taste")))
    return table(spark, folder, "external_cache").select(
        "cache_id", F.array_join(L.content_words("query"), " ").alias("content"), L.too_short("query").alias("too_short"), F.array_join(L.food_labels("text"), " ").alias("foods"), L.taste_notes("text").alias("tastes"),
        L.overlap_count("query", "name", "grape", "text").alias("overlap"), F.trim(F.regexp_replace(blob, " +", " ")).alias("blob"),
    )


@query(f"""
WITH t AS (SELECT row_idx, {S.tokens('grape')} AS g FROM strapi_output0709)
SELECT row_idx, array_to_string(list_transform(g, lambda x: {S.shown('x')}), ', ') AS shown, (SELECT coalesce(list_filter(string_split_regex(k, '[,;\\s]+'), lambda x: length(x) >= 4)[1], k) FROM (SELECT translate(lower({S.cell('grape')}), 'ё', 'е') AS k FROM strapi_output0709 s WHERE s.row_idx = t.row_idx)) AS grape_key FROM t""")
def grape_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each card's grapes in one line and its key among the grapes."""
    return table(spark, folder, "strapi_output0709").select("row_idx", L.shown_grapes(T.tokens("grape")).alias("shown"), L.grape_key("grape").alias("grape_key"))
