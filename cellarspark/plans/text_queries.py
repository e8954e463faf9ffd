"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.plans import sqltext as S
from cellarspark.plans.registry import query
from cellarspark.sources.tables import table


@query(f"SELECT trace_id, logged_at, {S.normalize('ocr')} AS norm FROM recognition_trace")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised observation texts."""
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", T.normalize("ocr").alias("norm"))


@query(f"SELECT trace_id, logged_at, array_to_string({S.tokens('ocr')}, ' ') AS tokens FROM recognition_trace")
def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the observation texts, letter runs joined."""
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.array_join(T.tokens("ocr"), " ").alias("tokens"))


_N = S.normalize("name")


@query(f"SELECT row_idx, {S.votes(_N, S.ONLY_LATIN)} AS latin, {S.votes(_N, S.ONLY_CYRILLIC)} AS cyrillic, {S.votes(_N, W.LOOK_LATIN)} AS look_latin, {S.votes(_N, W.LOOK_CYRILLIC)} AS look_cyrillic, {S.mostly_cyrillic(_N)} AS is_cyrillic FROM strapi_output0709")
def script_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of each script in the labels."""
    n = T.normalize("name")
    return table(spark, folder, "strapi_output0709").select("row_idx", T.script_votes(n).alias("v"), T.mostly_cyrillic(n).alias("is_cyrillic")).select("row_idx", "v.*", "is_cyrillic")


@query(f"SELECT row_idx, {S.fold(_N)} AS folded FROM strapi_output0709")
def homoglyph_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the look-alikes of mostly Cyrillic ones folded."""
    return table(spark, folder, "strapi_output0709").select("row_idx", T.fold_homoglyphs(T.normalize("name")).alias("folded"))


@query("""
SELECT cache_id, array_to_string(list_sort(list_distinct(list_filter(string_split(translate(%s, 'ОOI', '001'), ' '), lambda t: regexp_full_match(t, '(19|20)[0-9]{2}')))), ',') AS years
FROM external_cache""" % S.normalize("text"))
def extract_years(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct years that each page names."""
    return table(spark, folder, "external_cache").select("cache_id", F.array_join(F.array_sort(T.years("text")), ",").alias("years"))


_FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(f"""
SELECT doc_id, CASE WHEN length({_FLAT}) <= 160 THEN {_FLAT}
  ELSE regexp_replace(regexp_replace(substr({_FLAT}, 1, 160), ' [^ ]*$', ''), '[.,;:]+$', '') || '…' END AS short
FROM documents""")
def short_text(spark: SparkSession, folder: str) -> DataFrame:
    """Teasers of at most 160 characters."""
    return table(spark, folder, "documents").select("doc_id", T.short_text("text", 160).alias("short"))


@query("SELECT regexp_replace(slug, '-[0-9]{1,2}$', '') AS stem, count(*) AS n FROM strapi_output0709 GROUP BY 1")
def copy_stem(spark: SparkSession, folder: str) -> DataFrame:
    """Cards by slug without the number of a copy."""
    return table(spark, folder, "strapi_output0709").groupBy(T.copy_stem("slug").alias("stem")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter([{S.quoted(W.TASTE_STEMS)}], lambda s: contains({S.normalize('text')}, s)), ', ') AS stems FROM documents")
def taste_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Taste stems in each text."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(T.stems_found("text", W.TASTE_STEMS), ", ").alias("stems"))


_STEMS = ", ".join(f"{{'stem': '{s}', 'label': '{v}'}}" for s, v in W.SWEET_STEMS)
_SWEET = f"""list_reduce([{_STEMS}], lambda a, s: CASE WHEN contains(a.t, s.stem) AND NOT list_contains(a.f, s.label)
  THEN {{'t': replace(a.t, s.stem, ' '), 'f': list_append(a.f, s.label)}} ELSE a END, {{'t': {S.normalize('name')}, 'f': []::VARCHAR[]}}).f"""


@query(f"SELECT cache_id, CASE WHEN len({_SWEET}) = 1 THEN ({_SWEET})[1] END AS sweetness FROM external_cache")
def sweetness_class(spark: SparkSession, folder: str) -> DataFrame:
    """The one sweetness that a page's title names."""
    return table(spark, folder, "external_cache").select("cache_id", T.sweetness("name").alias("sweetness"))


_CAT, _SL = S.normalize("category"), S.normalize("replace(coalesce(slug, ''), '-', ' ')")


@query(f"""
SELECT row_idx, CASE WHEN contains({_CAT}, 'ОРАНЖ') THEN 'orange' WHEN contains({_CAT}, 'РОЗОВ') THEN 'rose' WHEN contains({_CAT}, 'КРАСН') THEN 'red'
  WHEN contains(' ' || {_CAT}, ' БЕЛ') THEN 'white' WHEN regexp_matches({_SL}, 'ORANZHEVOE|ORANGE') THEN 'orange' WHEN regexp_matches({_SL}, 'ROZOVOE|ROSE') THEN 'rose'
  WHEN contains({_SL}, 'KRASNOE') THEN 'red' WHEN contains({_SL}, 'BELOE') THEN 'white' END AS colour FROM strapi_output0709""")
def colour_class(spark: SparkSession, folder: str) -> DataFrame:
    """Colour of each card from its category, else its slug."""
    return table(spark, folder, "strapi_output0709").select("row_idx", T.colour_class("category", "slug").alias("colour"))


@query("SELECT cache_id, substr(lower(trim(regexp_replace(coalesce(query, ''), '[\\s\\x{00A0}]+', ' ', 'g'))), 1, 240) AS ask, sha256(lower(trim(regexp_replace(coalesce(query, ''), '[\\s\\x{00A0}]+', ' ', 'g')))) AS key FROM external_cache")
def lookup_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised lookup texts and the hash keys of their cache entries."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), "[\\s\\u00A0]+", " ")))
    return table(spark, folder, "external_cache").select("cache_id", F.substring(flat, 1, 240).alias("ask"), F.sha2(flat, 256).alias("key"))
