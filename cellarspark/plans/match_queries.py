"""Queries of dictionary joins, vectors, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import fuzzy, rerank, vectors
from cellarspark.operators.joins import join_even
from cellarspark.plans import sqltext as S
from cellarspark.plans.index_queries import _FIRST, catalog
from cellarspark.plans.registry import query
from cellarspark.sources.tables import cell, table

_LEX = f"(SELECT DISTINCT canonical, {S.normalize('lex_key')} AS entry FROM lexicon WHERE kind = 'grape')"
_WORDS = f"(SELECT DISTINCT w AS word FROM (SELECT unnest({S.tokens('ocr')}) AS w FROM recognition_trace))"


def _one_byte(c: str) -> str:
    """DuckDB counts edits in bytes; each Cyrillic capital as one byte."""
    return f"translate({c}, 'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ', 'abcdefghijklmnopqrstuvwxyz!#$%&*')"


def lexicon_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lexicon").where("kind = 'grape'").select("canonical", T.normalize("lex_key").alias("entry")).distinct()


def seen_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recognition_trace").select(F.explode(T.tokens("ocr")).alias("word")).distinct()


@query()
def fuzzy_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words that are near one grape and clearly nearer than to the next."""
    return fuzzy.margin_match(seen_words(spark, folder), lexicon_words(spark, folder), "word", "entry", 0.84, 0.04)


@query()
def near_generic(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words of five letters or more that nearly spell a filler."""
    stop = spark.createDataFrame([(w,) for w in sorted(set(W.NAME_STOP))], "entry string")
    seen = seen_words(spark, folder).where((F.length("word") >= 5) & ~F.col("word").isin(W.NAME_STOP))
    return fuzzy.margin_match(seen, stop, "word", "entry", 0.84, 0.0, window=1, always=True)


@query(f"SELECT word, min(canonical) AS canonical FROM {_WORDS} JOIN {_LEX} ON length(word) >= 6 AND starts_with(entry, word) AND length(entry) - length(word) <= 4 GROUP BY 1 HAVING min(canonical) = max(canonical)")
def prefix_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words that begin exactly one grape."""
    return fuzzy.unique_affix(seen_words(spark, folder), lexicon_words(spark, folder), "word", "entry", "canonical", 6, 4)


@query(f"SELECT word, min(canonical) AS canonical FROM {_WORDS} JOIN {_LEX} ON length(word) >= 5 AND ends_with(entry, word) AND length(entry) - length(word) <= 2 GROUP BY 1 HAVING min(canonical) = max(canonical)")
def suffix_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words that end exactly one grape, at most two letters short."""
    return fuzzy.unique_affix(seen_words(spark, folder), lexicon_words(spark, folder), "word", "entry", "canonical", 5, 2, suffix=True)


@query(f"SELECT word, min(canonical) AS canonical FROM {_WORDS} JOIN {_LEX} ON length(word) >= 4 AND abs(length(word) - length(entry)) <= 1 AND levenshtein({_one_byte("word")}, {_one_byte("entry")}) = 1 GROUP BY 1 HAVING min(canonical) = max(canonical)")
def one_edit_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words one edit from exactly one grape."""
    return fuzzy.unique_one_edit(seen_words(spark, folder), lexicon_words(spark, folder), "word", "entry", "canonical", 4)


_STRAY = f"(SELECT word FROM {_WORDS} UNION SELECT substr(entry, 1, 2) || 'N' || substr(entry, 4) FROM {_LEX})"
_HOLED = "regexp_replace(word, '[A-Z]', '_')"


@query(f"SELECT word, min(canonical) AS canonical FROM {_STRAY} JOIN {_LEX} ON length(word) >= 5 AND length(word) = length(entry) AND regexp_full_match(word, '[А-Я]+[A-Z][А-Я]+') AND entry LIKE {_HOLED} GROUP BY 1 HAVING min(canonical) = max(canonical)")
def wildcard_snap(spark: SparkSession, folder: str) -> DataFrame:
    """Cyrillic words with one stray Latin letter, that letter read as any: observed ones, and each grape with its third letter lost."""
    lost = lexicon_words(spark, folder).select(F.concat(F.substring("entry", 1, 2), F.lit("N"), F.substring("entry", 4, 1_000)).alias("word"))
    words = seen_words(spark, folder).union(lost).where(F.col("word").rlike("^[А-Я]+[A-Z][А-Я]+$"))
    return fuzzy.unique_wildcard(words, lexicon_words(spark, folder), "word", "entry", "canonical", "[A-Z]", 5)


_SIM = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)"
_TOP = f"(SELECT q.vec_id AS query_id, b.vec_id AS id, b.label AS label, {_SIM} AS score FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, b.vec_id) <= 30)"


@query(f"SELECT query_id, id, score FROM {_TOP}")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty nearest vectors of every query vector."""
    e = table(spark, folder, "embeddings")
    return vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 30).select("query_id", "id", "score")


@query(f"SELECT query_id, label, max(score) AS score, arg_max(id, score) AS id FROM (SELECT * FROM {_TOP} ORDER BY query_id, score DESC, id) GROUP BY 1, 2")
def vector_topk_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Of the thirty nearest the first of each label: the cut comes before the deduplication."""
    e = table(spark, folder, "embeddings")
    top = vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 30).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return top.groupBy("query_id", "label").agg(F.min(F.struct("place", "score", "id")).alias("r")).select("query_id", "label", "r.score", "r.id")


@query("SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def vector_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label."""
    m = vectors.mean_vectors(table(spark, folder, "embeddings"), "label", "embedding")
    return m.select("label", F.col("at").alias("pos"), F.round("value", 6).alias("value"))


@query("""
SELECT t.trace_id, t.logged_at, round(CASE WHEN m.hi > m.lo THEN (t.visual - m.lo) / (m.hi - m.lo) ELSE 0 END, 6) AS scaled FROM recognition_trace t JOIN (SELECT winner_slug, min(visual) AS lo, max(visual) AS hi FROM recognition_trace GROUP BY 1) m USING (winner_slug)""")
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Scores scaled to 0 to 1 within their leader."""
    t = table(spark, folder, "recognition_trace").where("winner_slug is not null").select("trace_id", "logged_at", "winner_slug", "visual")
    return rerank.min_max(t, "winner_slug", "visual").select("trace_id", "logged_at", F.round("scaled", 6).alias("scaled"))


@query("""
WITH a AS (SELECT winner_slug AS slug, avg(visual) AS led FROM recognition_trace WHERE winner_slug IS NOT NULL GROUP BY 1),
b AS (SELECT n.slug AS slug, avg(n.visual) AS near FROM (SELECT unnest(neighbors) AS n FROM recognition_trace) WHERE n.slug IS NOT NULL GROUP BY 1)
SELECT slug, round(0.6 * coalesce(led, 0) + 0.4 * coalesce(near, 0), 9) AS score FROM a FULL OUTER JOIN b USING (slug)""")
def full_outer_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Two score lists merged by card; a card missing in one counts 0 there."""
    t = table(spark, folder, "recognition_trace")
    a = t.where("winner_slug is not null").groupBy(F.col("winner_slug").alias("slug")).agg(F.avg("visual").alias("led"))
    b = t.select(F.explode("neighbors").alias("n")).where("n.slug is not null").groupBy(F.col("n.slug").alias("slug")).agg(F.avg("n.visual").alias("near"))
    zero = F.lit(0.0)
    return a.join(b, "slug", "full_outer").select("slug", F.round(0.6 * F.coalesce("led", zero) + 0.4 * F.coalesce("near", zero), 9).alias("score"))


_PAIR = f"""(SELECT t.trace_id, t.logged_at, t.winner_slug, n.slug AS slug, n.visual AS visual FROM (SELECT trace_id, logged_at, winner_slug, unnest(neighbors) AS n FROM recognition_trace) t)"""
_G = S.tokens("grape")


@query(f"""
WITH c AS (SELECT slug, {S.cell('category')} AS category, {S.cell('winery')} AS winery, {S.cell('region')} AS region, list_distinct({_G}) AS grapes FROM {_FIRST})
SELECT p.trace_id, p.logged_at, p.slug, p.visual, round(
  CASE WHEN w.category = '' OR k.category = '' THEN 0 WHEN w.category = k.category THEN 0.18 ELSE -0.25 END
  + CASE WHEN len(w.grapes) > 0 THEN 0.16 * len(list_intersect(w.grapes, k.grapes)) / len(w.grapes) ELSE 0 END
  + CASE WHEN w.winery <> '' AND w.winery = k.winery THEN 0.05 ELSE 0 END + CASE WHEN w.region <> '' AND w.region = k.region THEN 0.04 ELSE 0 END, 6) AS bonus
FROM {_PAIR} p JOIN c w ON w.slug = p.winner_slug JOIN c k ON k.slug = p.slug""")
def attribute_bonus(spark: SparkSession, folder: str) -> DataFrame:
    """How well each neighbour's attributes agree with the leader's."""
    c = catalog(spark, folder).select("slug", *[cell(x).alias(x) for x in ("category", "winery", "region")], F.array_distinct(T.tokens("grape")).alias("grapes"))
    p = table(spark, folder, "recognition_trace").select("trace_id", "logged_at", "winner_slug", F.explode("neighbors").alias("n")).select("trace_id", "logged_at", "winner_slug", "n.slug", "n.visual")
    w = c.select(F.col("slug").alias("winner_slug"), *[F.col(x).alias(f"w_{x}") for x in c.columns if x != "slug"])
    j = join_even(join_even(p, w, "winner_slug"), c, "slug")
    bonus = (
        F.when((F.col("w_category") == "") | (F.col("category") == ""), 0.0).when(F.col("w_category") == F.col("category"), 0.18).otherwise(-0.25)
        + F.when(F.size("w_grapes") > 0, 0.16 * F.size(F.array_intersect("w_grapes", "grapes")) / F.size("w_grapes")).otherwise(0.0)
        + F.when((F.col("w_winery") != "") & (F.col("w_winery") == F.col("winery")), 0.05).otherwise(0.0)
        + F.when((F.col("w_region") != "") & (F.col("w_region") == F.col("region")), 0.04).otherwise(0.0)
    )
    return j.select("trace_id", "logged_at", "slug", "visual", F.round(bonus, 6).alias("bonus"))


@query("""
SELECT trace_id, logged_at, round(1 / (1 + exp(-(-0.4 + 1.7 * (coalesce(visual, 0) - 0.5) / 0.2 + 0.8 * (len(neighbors) - 1.5) / 1.1))), 6) AS score FROM recognition_trace""")
def logistic_score(spark: SparkSession, folder: str) -> DataFrame:
    """A logistic head over standardised features."""
    head = [1.7, 0.8, 0.0, 0.0, 0.0, 0.0, -0.4, 0.5, 1.5, 0.0, 0.0, 0.0, 0.0, 0.2, 1.1, 1.0, 1.0, 1.0, 1.0]
    features = [F.col("visual"), F.size("neighbors").cast("double"), *[F.lit(0.0)] * 4]
    return table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.round(rerank.logistic(features, head), 6).alias("score"))


@query(f"SELECT trace_id, logged_at, slug, round_even(visual / 0.02, 0) AS band FROM {_PAIR} WHERE visual IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, logged_at ORDER BY round_even(visual / 0.02, 0) DESC, slug, visual DESC) = 1")
def vintage_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The first neighbour of each request by score bands of 0.02, ties by slug."""
    band = F.bround(F.col("n.visual") / 0.02, 0)
    t = table(spark, folder, "recognition_trace").select("trace_id", "logged_at", F.explode("neighbors").alias("n")).where("n.visual is not null")
    first = t.groupBy("trace_id", "logged_at").agg(F.min(F.struct((-band).alias("b"), F.col("n.slug").alias("slug"))).alias("r"))
    return first.select("trace_id", "logged_at", "r.slug", (-F.col("r.b")).alias("band"))


_ASK = "['ПЬЕРЛАН', 'СОЛЬМЕРА']"
_LEVEL = f"CASE WHEN category = 'Белое' AND list_has_all(grapes, {_ASK}) THEN 1 WHEN category = 'Белое' AND list_has_any(grapes, {_ASK}) THEN 2 WHEN list_has_all(grapes, {_ASK}) THEN 3 WHEN list_has_any(grapes, {_ASK}) THEN 4 WHEN category = 'Белое' THEN 5 ELSE 6 END"


@query(f"WITH l AS (SELECT row_idx, {_LEVEL} AS level FROM (SELECT row_idx, {S.cell('category')} AS category, {_G} AS grapes FROM {_FIRST})) SELECT row_idx, level FROM l WHERE level = (SELECT min(level) FROM l)")
def eligible_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Cards at the strictest level of an ask (colour and grapes) that any card meets."""
    ask = F.array(F.lit("ПЬЕРЛАН"), F.lit("СОЛЬМЕРА"))
    white, every, some = cell("category") == "Белое", F.size(F.array_except(ask, "grapes")) == 0, F.arrays_overlap("grapes", ask)
    level = F.when(white & every, 1).when(white & some, 2).when(every, 3).when(some, 4).when(white, 5).otherwise(6)
    l = catalog(spark, folder).withColumn("grapes", T.tokens("grape")).select("row_idx", level.alias("level"))
    best = F.broadcast(l.agg(F.min("level").alias("level")))  # one row
    return l.join(best, "level").select("row_idx", "level")


@query(f"""
SELECT row_idx, slug FROM (SELECT row_idx, slug, len(list_intersect(list_distinct({_G}), {_ASK})) AS k1, CAST({S.cell('category')} = 'Белое' AS INT) AS k2, CAST({S.cell('winery')} = 'Дом Тюрвани' AS INT) AS k3,
  len(list_filter([{S.quoted(W.TASTE_STEMS)}], lambda s: contains({S.normalize('description')}, s))) AS k4 FROM {_FIRST}) WHERE k1 + k2 + k3 + k4 > 0 ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, row_idx LIMIT 4""")
def six_key_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The four cards nearest to a profile, by one attribute after another."""
    ask = F.array(F.lit("ПЬЕРЛАН"), F.lit("СОЛЬМЕРА"))
    keys = [F.size(F.array_intersect(F.array_distinct(T.tokens("grape")), ask)), (cell("category") == "Белое").cast("int"), (cell("winery") == "Дом Тюрвани").cast("int"), F.size(T.stems_found("description", W.TASTE_STEMS))]
    k = catalog(spark, folder).select("row_idx", "slug", *[x.alias(f"k{i}") for i, x in enumerate(keys)])
    return k.where("k0 + k1 + k2 + k3 > 0").orderBy(F.desc("k0"), F.desc("k1"), F.desc("k2"), F.desc("k3"), "row_idx").limit(4).select("row_idx", "slug")


_D = """(SELECT trace_id, logged_at, method, coalesce(final_score, 0) AS top, coalesce(visual, 0) AS v, len(neighbors) AS size, coalesce(neighbors[1].visual, 0) AS second FROM recognition_trace)"""


@query(f"""
SELECT trace_id, logged_at, CASE WHEN method IN ('barcode', 'qr', 'code') THEN true WHEN size = 0 AND (top >= 0.55 OR v >= 0.65) THEN true
  WHEN top < 0.25 AND v >= 0.75 AND v - second >= 0.20 THEN true WHEN v - second < -0.02 THEN false WHEN v = second AND top - second < 0.08 THEN false WHEN top >= 0.75 AND top - second >= 0.20 THEN true ELSE false END AS accepted FROM {_D}""")
def decision_list(spark: SparkSession, folder: str) -> DataFrame:
    """An ordered list of rules over leader and runner-up; the first that fits decides."""
    t = table(spark, folder, "recognition_trace")
    zero = F.lit(0.0)
    d = t.select("trace_id", "logged_at", "method", F.coalesce("final_score", zero).alias("top"), F.coalesce("visual", zero).alias("v"), F.size("neighbors").alias("size"), F.coalesce(F.get("neighbors", F.lit(0))["visual"], zero).alias("second"))
    top, v, gap, vgap = F.col("top"), F.col("v"), F.col("top") - F.col("second"), F.col("v") - F.col("second")
    rules = (
        F.when(F.col("method").isin("barcode", "qr", "code"), True).when((F.col("size") == 0) & ((top >= 0.55) | (v >= 0.65)), True).when((top < 0.25) & (v >= 0.75) & (vgap >= 0.20), True)
        .when(vgap < -0.02, False).when((v == F.col("second")) & (gap < 0.08), False).when((top >= 0.75) & (gap >= 0.20), True).otherwise(False)
    )
    return d.select("trace_id", "logged_at", rules.alias("accepted"))
