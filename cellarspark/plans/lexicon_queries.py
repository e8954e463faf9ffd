"""Queries of the lexicon, candidates by words, and the order of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import fuzzy, lexicon
from cellarspark.operators import index as I
from cellarspark.operators.joins import join_even
from cellarspark.plans import sqltext as S
from cellarspark.plans.index_queries import _FIRST, catalog
from cellarspark.plans.lineage import cut
from cellarspark.plans.match_queries import _WORDS, _one_byte, seen_words
from cellarspark.plans.ranking_queries import _REQ, requests
from cellarspark.plans.registry import query
from cellarspark.plans.request_queries import _RANK, _TOKENS
from cellarspark.sources.tables import table

_OWN = f"(SELECT token AS key, arg_max(kind, {_RANK}) AS kind FROM ({_TOKENS}) WHERE length(token) >= 4 AND NOT {S.generic('token')} GROUP BY 1)"
_SPELLINGS = ", ".join([f"('{k}', '{v}', 'winery')" for k, v in W.LATIN_WINERIES.items()] + [f"('{k}', '{v}', 'grape')" for k, v in {**W.CLIPPED_GRAPES, **W.LATIN_GRAPES}.items()])
_SCRIPT = "CASE WHEN {lat} > 0 AND {cyr} = 0 THEN 'lat' ELSE 'cyr' END"
_KEYSCRIPT = _SCRIPT.format(lat=S.votes("key", S.ONLY_LATIN), cyr=S.votes("key", S.ONLY_CYRILLIC))
_LEX = f"""(WITH o AS {_OWN}, a AS (SELECT s.key, s.canonical, s.kind, true AS alias FROM (VALUES {_SPELLINGS}) s(key, canonical, kind) JOIN o ON o.key = s.canonical)
SELECT *, {_KEYSCRIPT} AS script FROM (SELECT key, key AS canonical, kind, false AS alias FROM o WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT * FROM a))"""


def catalog_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon of the catalog's grapes, makers, names and regions."""
    return lexicon.build_lexicon(I.postings(catalog(spark, folder), {k: k for k in lexicon.KINDS}).select("token", "kind").distinct())


@query(f"SELECT key, canonical, kind, alias, script FROM {_LEX}")
def lexicon_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon with other spellings and scripts."""
    return catalog_lexicon(spark, folder)


_LAT, _CYR = S.votes("word", S.ONLY_LATIN), S.votes("word", S.ONLY_CYRILLIC)
_TWIN = f"translate(word, '{W.LOOK_CYRILLIC}', '{W.LOOK_LATIN}')"
_MOSTLY = S.mostly_cyrillic("word")
_READ = f"""SELECT word, 1 AS o, {S.repair('word')} AS form, 'cyr' AS script FROM w WHERE {_CYR} > 0 AND {_LAT} > 0 OR {_LAT} = 0 OR {_MOSTLY} UNION ALL SELECT word, 2, {_TWIN}, 'lat' FROM w WHERE {_CYR} > 0 AND {_LAT} > 0
UNION ALL SELECT word, 2, word, 'lat' FROM w WHERE NOT ({_CYR} > 0 AND {_LAT} > 0) AND ({_LAT} = 0 OR {_MOSTLY}) AND {S.repair('word')} <> word UNION ALL SELECT word, 1, word, 'lat' FROM w WHERE NOT ({_CYR} > 0 AND {_LAT} > 0) AND NOT ({_LAT} = 0 OR {_MOSTLY})"""
_STRAYED = f"regexp_replace(translate(word, '{W.LOOK_LATIN}', '{W.LOOK_CYRILLIC}'), '[{W.DISTINCT_LATIN}]', '_', 'g')"
_HITS = f"""(WITH lex AS MATERIALIZED (SELECT * FROM {_LEX}), v AS MATERIALIZED (SELECT word FROM {_WORDS} WHERE NOT {S.generic('word')} AND NOT {S.brut('word')} AND word NOT IN ({S.quoted(W.NOIR_GATED)})), w AS (SELECT word FROM v WHERE length(word) >= 4),
r AS MATERIALIZED ({_READ}), f AS MATERIALIZED (SELECT DISTINCT form, script FROM r WHERE NOT {S.brut('form')} AND length(form) >= 4 AND NOT {S.generic('form')}),
e AS (SELECT f.form, f.script, canonical, kind, CASE WHEN alias THEN 0.99 ELSE 1.0 END AS score FROM f JOIN lex ON key = form AND lex.script = f.script),
p AS MATERIALIZED (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.form = f.form AND e.script = f.script) AND NOT {S.near_filler('form')}),
s AS (SELECT p.form, p.script, key, canonical, kind, {S.ratio('form', 'key')} AS score FROM p JOIN lex ON lex.script = p.script AND abs(length(key) - length(form)) <= 2 AND length(form) >= CASE WHEN p.script = 'cyr' THEN 5 ELSE 4 END),
n AS (SELECT *, row_number() OVER (PARTITION BY form, script ORDER BY score DESC, key) AS n FROM s WHERE score >= CASE WHEN script = 'cyr' THEN 0.84 ELSE 0.8 END),
z AS MATERIALIZED (SELECT form, script, max(canonical) FILTER (n = 1) AS canonical, max(kind) FILTER (n = 1) AS kind, max(score) AS score FROM n GROUP BY 1, 2 HAVING count(*) = 1 OR max(score) FILTER (n = 1) - max(score) FILTER (n = 2) >= CASE WHEN script = 'cyr' THEN 0.04 ELSE 0.05 END),
d AS (SELECT form, script, min(canonical) AS canonical, CASE WHEN script = 'lat' THEN 'grape' ELSE 'winery' END AS kind, CASE WHEN script = 'lat' THEN 0.9 ELSE 0.88 END AS score FROM (SELECT p.*, canonical FROM p JOIN lex ON lex.script = p.script AND length(form) >= 5 AND abs(length(key) - length(form)) <= 1
  AND ((p.script = 'lat' AND lex.alias AND lex.kind = 'grape') OR (p.script = 'cyr' AND NOT lex.alias AND lex.kind = 'winery')) AND levenshtein({_one_byte('form')}, {_one_byte('key')}) = 1 WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.form = p.form AND z.script = p.script)) GROUP BY 1, 2 HAVING min(canonical) = max(canonical)),
k AS (SELECT word, 9 AS o, min(canonical) AS canonical, min(kind) AS kind, 0.9 AS score FROM w JOIN lex ON NOT alias AND script = 'cyr' AND {_LAT} = 1 AND {_CYR} > 0 AND length(key) = length(word) AND key LIKE {_STRAYED} GROUP BY 1 HAVING min(canonical) = max(canonical)),
a AS (SELECT word, 0 AS o, canonical, kind, 0.99 AS score FROM v JOIN lex ON key = word AND alias AND kind = 'grape' AND length(word) = 3 UNION ALL SELECT word, o, canonical, kind, score FROM r JOIN (SELECT * FROM e UNION ALL SELECT * FROM z UNION ALL SELECT * FROM d) USING (form, script) UNION ALL SELECT * FROM k)
SELECT word, arg_min(canonical, o) AS catalog, arg_min(kind, o) AS kind, arg_min(score, o) AS score FROM a GROUP BY 1)"""


@query(f"SELECT word, catalog, kind, score FROM {_HITS}")
def lexicon_hits(spark: SparkSession, folder: str) -> DataFrame:
    """What every observed word means in the lexicon: itself, the nearest entry, one edit, or one letter lost."""
    return lexicon.match_words(seen_words(spark, folder), catalog_lexicon(spark, folder))


@query()
def lexicon_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every request's text as catalog words, with the words that could not be placed but can be said."""
    tokens = requests(spark, folder).select("trace_id", F.posexplode(T.tokens("ocr")).alias("pos", "word"))
    return lexicon.clean_texts(tokens, "trace_id", lexicon.match_words(tokens, catalog_lexicon(spark, folder)))


_NAMED = f"(SELECT DISTINCT unnest({S.tokens('name')}) AS token, slug FROM {_FIRST})"
_MADE = f"(SELECT DISTINCT unnest({S.tokens('winery')}) AS token, slug FROM {_FIRST})"
_HELD = f"(SELECT DISTINCT unnest({S.tokens('grape')}) AS token, slug FROM {_FIRST})"


@query(f"""
WITH n AS (SELECT token, slug, count(*) OVER (PARTITION BY token) AS df FROM {_NAMED} WHERE token NOT IN ({S.quoted(W.LINE_FILLERS)}) AND NOT {S.generic('token')}), m AS (SELECT * FROM {_MADE} WHERE length(token) >= 5 AND NOT {S.generic('token')})
SELECT token, min(maker) AS maker FROM (SELECT n.token, m.token AS maker, n.df FROM n JOIN m USING (slug) WHERE df <= 80 GROUP BY 1, 2, 3 HAVING count(*) = n.df) GROUP BY 1""")
def house_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Name words all of whose cards are of one maker, with the maker's word."""
    post = I.postings(catalog(spark, folder), {"name": "name", "winery": "winery"})
    names = post.where((F.col("kind") == "name") & ~F.col("token").isin(*W.LINE_FILLERS) & ~T.is_generic(F.col("token"))).select("token", "slug")
    rare = names.groupBy("token").agg(F.count("*").alias("df")).where("df <= 80")
    made = post.where((F.col("kind") == "winery") & (F.length("token") >= 5) & ~T.is_generic(F.col("token"))).select(F.col("token").alias("maker"), "slug")
    return names.join(rare, "token").join(made, "slug").groupBy("token", "maker", "df").count().where("count = df").groupBy("token").agg(F.min("maker").alias("maker"))


@query(f"""
WITH s AS (SELECT trace_id, unnest({S.tokens('ocr')}) AS token FROM {_REQ}), m AS (SELECT token, count(*) AS owners FROM {_MADE} GROUP BY 1), g AS (SELECT DISTINCT token FROM {_HELD})
SELECT trace_id, arg_min(token, struct_pack(owners := owners, token := token)) AS maker, min(owners) AS owners FROM s JOIN m USING (token) WHERE length(token) >= 4 AND NOT {S.generic('token')} AND token NOT IN (SELECT token FROM g) AND token NOT IN ({S.quoted(list(W.LATIN_GRAPES | W.CLIPPED_GRAPES))}) GROUP BY 1""")
def maker_of_request(spark: SparkSession, folder: str) -> DataFrame:
    """The maker that each request names: of several the one with the fewest cards."""
    post = I.postings(catalog(spark, folder), {"winery": "winery", "grape": "grape"})
    return _named_makers(post, requests(spark, folder).select("trace_id", F.explode(T.tokens("ocr")).alias("token")))


def _named_makers(post: DataFrame, seen: DataFrame) -> DataFrame:
    """(trace_id, maker, owners) of the words `seen` (trace_id, token) by the makers and grapes of the postings."""
    makers = post.where("kind = 'winery'").groupBy("token").agg(F.count("*").alias("owners"))
    t = F.col("token")
    makers = makers.where((F.length(t) >= 4) & ~T.is_generic(t) & ~t.isin(*W.LATIN_GRAPES, *W.CLIPPED_GRAPES)).join(post.where("kind = 'grape'").select("token").distinct(), "token", "left_anti")
    found = join_even(seen, makers, "token").groupBy("trace_id").agg(F.min(F.struct("owners", "token")).alias("r"))
    return found.select("trace_id", F.col("r.token").alias("maker"), "r.owners")


_OWNERS = f"(SELECT DISTINCT token, slug FROM (SELECT * FROM {_NAMED} UNION ALL SELECT * FROM {_MADE} UNION ALL SELECT * FROM {_HELD}))"
_ASKS = f"(SELECT cache_id, unnest(list_distinct({S.tokens('query')})) AS token, 'a' AS side FROM external_cache UNION ALL SELECT cache_id, unnest(list_distinct({S.tokens('name')})), 'b' FROM external_cache)"


@query(f"""
WITH p AS {_ASKS}, o AS {_OWNERS}, a AS (SELECT DISTINCT p.cache_id, p.token FROM p JOIN o USING (token) WHERE side = 'a'), n AS (SELECT cache_id, count(*) AS n FROM a GROUP BY 1),
x AS (SELECT a.cache_id, o.slug, count(*) AS c FROM a JOIN o USING (token) GROUP BY 1, 2), best AS (SELECT cache_id, max(c) AS c FROM x GROUP BY 1), z AS (SELECT x.cache_id, x.slug FROM x JOIN n USING (cache_id) JOIN best USING (cache_id) WHERE x.c = n.n OR best.c < n.n)
SELECT DISTINCT b.cache_id, b.token FROM (SELECT * FROM p WHERE side = 'b') b WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.side = 'a' AND q.cache_id = b.cache_id AND q.token = b.token) AND (NOT EXISTS (SELECT 1 FROM z WHERE z.cache_id = b.cache_id) OR EXISTS (SELECT 1 FROM z JOIN o USING (slug) WHERE z.cache_id = b.cache_id AND o.token = b.token))""")
def compatible_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a second reading that fit the cards of the first: those of all its words, else of any; without such cards all fit."""
    pages = table(spark, folder, "external_cache")
    words_of = lambda c: F.coalesce(F.array_distinct(T.tokens(c)), F.array().cast("array<string>"))
    cards = cut(catalog(spark, folder).select(F.monotonically_increasing_id().alias("slug"), F.array_distinct(F.concat(*map(words_of, ("name", "winery", "grape")))).alias("words")))
    own = cards.select("slug", F.explode("words").alias("word"))
    # numbers by rarity: the least of a set is its rarest word
    numbers = cut(own.groupBy("word").agg(F.count("*").alias("df")).orderBy("df", "word").select("word", F.monotonically_increasing_id().alias("token")))
    owners = cut(own.join(numbers, "word").select("token", "slug"))
    read = pages.where("cache_id is not null").select("cache_id", words_of("query").alias("first"), words_of("name").alias("second"))
    told = lambda words, asked: F.transform(words, lambda x: F.struct(x.alias("word"), F.lit(asked).alias("asked")))
    said = read.select("cache_id", F.explode(F.concat(told("first", True), told(F.array_except("second", "first"), False))).alias("s")).select("cache_id", "s.*")
    known = lambda asked: F.array_sort(F.collect_set(F.when(F.col("asked") == asked, F.col("token"))))
    # the owned words of each ask and of its second reading
    asks = said.join(numbers, "word").groupBy("cache_id").agg(known(True).alias("words"), known(False).alias("others")).where(F.size("words") > 0)
    asks = cut(asks.select("cache_id", "words", F.array_except("others", "words").alias("others")))
    # asks of the same words are one
    groups = asks.select("words", F.explode("others").alias("token")).groupBy("words").agg(F.collect_set("token").alias("others"))
    whole = _together(groups.select("words", F.col("words").alias("all")), owners)
    many = cut(groups.join(whole.withColumn("whole", F.lit(True)), "words", "left")).select("words", "whole", F.explode("others").alias("token"))
    # a card has all of the ask's words and the other one, or, where none has all, one of them and the other
    needed = many.where("whole").select("words", "token", F.array_sort(F.array_append("words", F.col("token"))).alias("all"))
    any_of = many.where("whole is null").select("words", "token", F.explode("words").alias("word")).select("words", "token", F.array_sort(F.array("word", "token")).alias("all"))
    sets = needed.unionByName(any_of)
    held = _together(sets.select(F.col("all").alias("words"), "all").distinct(), owners).withColumnRenamed("words", "all")
    fit = sets.join(held, "all", "left_semi").groupBy("words").agg(F.collect_set("token").alias("fit"))
    fits = asks.join(fit, "words").select("cache_id", F.explode(F.array_intersect("others", "fit")).alias("token")).join(numbers, "token").select("cache_id", F.col("word").alias("token"))
    loose = pages.select("cache_id", "query", "name").join(asks.select("cache_id"), "cache_id", "left_anti")
    free = loose.select("cache_id", F.explode(words_of("name")).alias("token")).distinct().join(loose.select("cache_id", F.explode(words_of("query")).alias("token")), ["cache_id", "token"], "left_anti")
    return fits.unionByName(free)


def _together(sets: DataFrame, owners: DataFrame) -> DataFrame:
    """The distinct `words` of those `sets` (words, all) all of whose words `all` one card owns, by distinct `owners` (token, slug).

    A set meets only the cards of its least word, of them only their greater words, and leaves its task only where it is found.
    Right whatever the order of the words, fast where rare ones come first.
    """
    at = F.posexplode("own").alias("at", "token")
    cards = owners.groupBy("slug").agg(F.array_sort(F.collect_list("token")).alias("own")).select("own", at).select("token", F.expr("slice(own, at + 2, size(own))").alias("all"))
    kind = sets.schema["words"].dataType.simpleString()
    met = sets.select(F.array_min("all").alias("token"), "words", "all").unionByName(cards.select("token", F.lit(None).cast(kind).alias("words"), "all"))
    return met.repartition("token").sortWithinPartitions("token", F.col("words").isNull()).mapInArrow(I.sets_on_cards, f"words {kind}").distinct()


_YEARS = f"list_distinct(list_filter(string_split(translate({S.normalize('ocr')}, 'ОOI', '001'), ' '), lambda t: regexp_full_match(t, '(19|20)[0-9]{{2}}')))"


@query(f"""
WITH n AS (SELECT trace_id, {_YEARS} AS years, generate_subscripts(neighbors, 1) AS pos, unnest(neighbors) AS n FROM {_REQ}), h AS (SELECT trace_id, pos, n.slug AS slug, coalesce(n.visual, 0) AS v, len(list_filter(years, lambda y: contains(n.slug, y))) > 0 AS hit FROM n WHERE n.slug IS NOT NULL),
u AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY trace_id) = 1 AS one FROM h)
SELECT trace_id, slug, pos AS reported, row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN one THEN round_even(v / 0.02, 0) ELSE v END DESC, CASE WHEN one THEN hit::INT ELSE 0 END DESC, v DESC, pos) AS place FROM u""")
def candidate_order(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of each request by score; one vintage among them that the text names wins within a band of 0.02."""
    last = requests(spark, folder).select("trace_id", T.years("ocr").alias("years"), "neighbors")
    n = last.withColumn("n", F.filter(F.transform("neighbors", lambda x, i: F.struct((i + 1).alias("pos"), x["slug"].alias("slug"), F.coalesce(x["visual"], F.lit(0.0)).alias("v"), F.exists("years", lambda y: F.contains(x["slug"], y)).alias("hit"))), lambda x: x["slug"].isNotNull()))
    one = F.size(F.filter("n", lambda x: x["hit"])) == 1
    keyed = F.transform("n", lambda x: F.struct(F.when(F.col("one"), -F.bround(x["v"] / 0.02, 0)).otherwise(-x["v"]).alias("a"), F.when(F.col("one") & x["hit"], -1).otherwise(0).alias("b"), (-x["v"]).alias("c"), x["pos"].alias("pos"), x["slug"].alias("slug")))
    out = n.withColumn("one", one).select("trace_id", F.posexplode(F.array_sort(keyed)).alias("at", "k"))
    return out.select("trace_id", "k.slug", F.col("k.pos").cast("long").alias("reported"), (F.col("at") + 1).cast("long").alias("place"))


@query(f"""
WITH s AS (SELECT DISTINCT trace_id, unnest({S.tokens('ocr')}) AS token FROM {_REQ}), m AS (SELECT token, slug, count(*) OVER (PARTITION BY token) AS owners FROM {_MADE} WHERE length(token) >= 4 AND NOT {S.generic('token')}),
p AS (SELECT trace_id, arg_min(token, struct_pack(owners := owners, token := token)) AS maker FROM s JOIN m USING (token) GROUP BY 1), r AS (SELECT token, slug FROM {_NAMED} QUALIFY count(*) OVER (PARTITION BY token) <= 12),
x AS (SELECT p.trace_id, m.slug, count(*) AS hits FROM p JOIN m ON m.token = p.maker JOIN r ON r.slug = m.slug JOIN s ON s.trace_id = p.trace_id AND s.token = r.token AND s.token <> p.maker GROUP BY 1, 2)
SELECT trace_id, arg_max(slug, hits) AS slug, max(hits) AS hits FROM x GROUP BY 1 HAVING count(*) FILTER (hits = (SELECT max(hits) FROM x y WHERE y.trace_id = x.trace_id)) = 1""")
def unique_title(spark: SparkSession, folder: str) -> DataFrame:
    """The one card of the request's maker that most of its rare name words name."""
    post = I.postings(catalog(spark, folder), {"winery": "winery", "name": "name"})
    seen = cut(requests(spark, folder).select("trace_id", F.explode(F.array_distinct(T.tokens("ocr"))).alias("token")))
    made = post.where((F.col("kind") == "winery") & (F.length("token") >= 4) & ~T.is_generic(F.col("token"))).select("token", "slug")
    makers = made.groupBy("token").agg(F.count("*").alias("owners"))
    maker = join_even(seen, makers, "token").groupBy("trace_id").agg(F.min(F.struct("owners", "token")).alias("r")).select("trace_id", F.col("r.token").alias("maker"))
    names = post.where("kind = 'name'").select("token", "slug")
    rare = names.join(names.groupBy("token").agg(F.count("*").alias("df")).where("df <= 12"), "token")
    # rare words first, so that a maker's many cards are met only where one of them is named
    named = seen.join(rare, "token").join(maker, "trace_id").where("token <> maker").join(made.withColumnRenamed("token", "maker"), ["maker", "slug"])
    x = named.groupBy("trace_id", "slug").agg(F.count("*").alias("hits"))
    top = x.groupBy("trace_id").agg(F.max("hits").alias("best"))
    return x.join(top, "trace_id").where("hits = best").groupBy("trace_id").agg(F.min("slug").alias("slug"), F.max("hits").alias("hits"), F.count("*").alias("n")).where("n = 1").drop("n")


@query()
def house_names_recovered(spark: SparkSession, folder: str) -> DataFrame:
    """Misread name words of each request's maker: the clearly nearest name of that maker's own cards."""
    post = cut(I.postings(catalog(spark, folder), {k: k for k in ("winery", "name", "grape")}))
    last = cut(requests(spark, folder).select("trace_id", F.explode(F.array_distinct(T.tokens("ocr"))).alias("word")))
    maker = _named_makers(post, last.withColumnRenamed("word", "token")).select("trace_id", "maker")
    made = post.where("kind = 'winery'").select(F.col("token").alias("maker"), "slug")
    names = post.where((F.col("kind") == "name") & (F.length("token") >= 4) & ~T.is_generic(F.col("token")) & ~F.col("token").isin(*W.LINE_FILLERS)).select(F.col("token").alias("title"), "slug")
    few = names.groupBy("title").agg(F.count("*").alias("df")).where("df <= 40").select("title")
    titles = made.join(names.join(few, "title"), "slug").select("maker", "title").distinct()
    known = names.select(F.col("title").alias("word")).distinct()
    words = cut(last.where((F.length("word") >= 4) & ~T.is_generic(F.col("word"))).join(known, "word", "left_anti").join(maker, "trace_id"))
    # a word is read once a maker, however many requests have it
    pairs = fuzzy.near_pairs_within(words, titles, "maker", "word", "title", 0.70, 2)
    met = pairs.groupBy("maker", "word").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "title"))).alias("r"))
    best, second = -F.col("r")[0]["s"], F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0))
    both = F.concat_ws(" ", "maker", "word").alias("both")
    read = cut(met.where((best >= 0.75) & (best - second >= 0.05)).select(both, F.col("r")[0]["title"].alias("title")))
    return join_even(words.select("trace_id", "word", both), read, "both").select("trace_id", "word", "title")


_RARE = f"(SELECT token AS entry FROM {_NAMED} GROUP BY 1 HAVING count(*) <= 12 AND length(token) >= 5)"
_BIG = f"(SELECT token AS entry FROM {_MADE} GROUP BY 1 HAVING count(*) <= 40 AND length(token) >= 7)"


def _fuzzy_sql(entries: str, least: float, lead: float) -> str:
    return f"""SELECT word, max(entry) FILTER (n = 1) AS entry FROM (SELECT word, entry, score, row_number() OVER (PARTITION BY word ORDER BY score DESC, entry) AS n FROM (SELECT word, entry, {S.ratio('word', 'entry')} AS score FROM {_WORDS} JOIN {entries} ON length(word) >= 5 AND abs(length(entry) - length(word)) <= 1))
WHERE word IS NOT NULL GROUP BY 1 HAVING max(score) >= {least} AND max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0) >= {lead}"""


@query(_fuzzy_sql(_RARE, 0.86, 0.05))
def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words one slip from a rare name word, clearly nearer than to any other."""
    names = I.postings(catalog(spark, folder), {"name": "name"}).groupBy(F.col("token").alias("entry")).agg(F.count("*").alias("df")).where((F.col("df") <= 12) & (F.length("entry") >= 5))
    return fuzzy.margin_match(seen_words(spark, folder).where(F.length("word") >= 5), names, "word", "entry", 0.86, 0.05, window=1, always=True).select("word", "entry")


@query(_fuzzy_sql(_BIG, 0.85, 0.04))
def fuzzy_makers(spark: SparkSession, folder: str) -> DataFrame:
    """Observed words one slip from a maker's long word, clearly nearer than to any other."""
    made = I.postings(catalog(spark, folder), {"winery": "winery"}).groupBy(F.col("token").alias("entry")).agg(F.count("*").alias("df")).where((F.col("df") <= 40) & (F.length("entry") >= 7))
    return fuzzy.margin_match(seen_words(spark, folder).where(F.length("word") >= 5), made, "word", "entry", 0.85, 0.04, window=1, always=True).select("word", "entry")


@query()
def match_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """From what was observed to a card for all requests at once: words, their meaning in the lexicon, candidates by rare words,
    fusion with the reported score, leader and lead.  Requests without a candidate stay, with the reason."""
    cards = catalog(spark, folder)
    post, freq = I.postings(cards, {"name": "name"}), I.token_frequencies(cards, {"name": "name"})
    seen = requests(spark, folder, ("ocr", "winner_slug", "visual"))
    last = cut(seen.select("trace_id", F.array_distinct(T.tokens("ocr")).alias("words"), "winner_slug", F.coalesce("visual", F.lit(0.0)).alias("visual")))
    words = last.select("trace_id", F.explode("words").alias("word"))
    distinct = cut(words.select("word").distinct())
    meant = lexicon.match_words(distinct, catalog_lexicon(spark, folder)).select("word", "catalog")
    read = distinct.join(meant, "word", "left").select("word", F.coalesce("catalog", "word").alias("token"), F.col("catalog").isNotNull().alias("known"))
    rare = I.rare_tokens(freq)
    # words that mean nothing and name no card tell nothing
    told = cut(read.join(rare.select("token", F.lit(True).alias("rare")), "token", "left").where("known or rare").select("word", "known", F.when(F.col("rare"), F.col("token")).alias("token")))
    asked = cut(join_even(words, told, "word").groupBy("trace_id").agg(F.max("known").alias("known"), F.collect_set("token").alias("tokens")))
    scored = I.rare_scores(asked.select("trace_id", F.explode("tokens").alias("token")), post, freq, "trace_id", "slug")
    reported = last.where("winner_slug is not null").select("trace_id", F.col("winner_slug").alias("slug"), F.lit(0.0).alias("score"))
    every = scored.select("trace_id", "slug", "score").unionByName(reported).groupBy("trace_id", "slug").agg(F.max("score").alias("score")).join(last.drop("words"), "trace_id")
    fused = every.withColumn("fused", 0.75 * F.least(F.lit(1.0), F.col("score") / 10) + 0.25 * F.when(F.col("slug") == F.col("winner_slug"), F.col("visual")).otherwise(0.0))
    top = I.top_per(fused, "trace_id", [F.desc("fused"), F.asc("slug")], 2)
    led = top.groupBy("trace_id").agg(F.max_by("slug", -F.col("place")).alias("slug"), F.max("fused").alias("fused"), F.max("score").alias("score"), F.min(F.when(F.col("place") == 2, F.col("fused"))).alias("second"))
    out = last.select("trace_id").join(led, "trace_id", "left").join(asked.select("trace_id", "known"), "trace_id", "left")
    reason = F.when(F.col("score") > 0, "rare word").when(F.col("slug").isNotNull(), "reported leader").when(F.coalesce("known", F.lit(False)), "common words only").otherwise("no known word")
    return out.select("trace_id", "slug", F.round("fused", 6).alias("fused"), F.round(F.col("fused") - F.coalesce("second", F.lit(0.0)), 6).alias("lead"), reason.alias("reason"))
