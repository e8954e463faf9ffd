"""Queries that rank cards by attributes and decide whether the leader is meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.functions import labels as L
from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import decisions as D
from cellarspark.operators import signals as G
from cellarspark.operators.joins import join_even
from cellarspark.plans import sqltext as S
from cellarspark.plans.index_queries import catalog
from cellarspark.plans.label_queries import _ASKED, _CARDS, _PAGE_TEXT, _sql_signals, grapes, page_text
from cellarspark.plans.lineage import cut
from cellarspark.plans.registry import query
from cellarspark.plans.request_queries import _LEXICON, lexicon
from cellarspark.sources.tables import table

_ONE_SWEET = "CASE WHEN len(sweets) = 1 THEN sweets[1] END"
_BRANDS = f"list_distinct(list_filter({S.tokens('e.winery')}, lambda t: length(t) >= 4 AND NOT {S.generic('t')}))"
_REASONS = (
    f"concat_ws(', ', CASE WHEN grape > 0 THEN '{W.REASONS['grape']}' END, CASE WHEN colour > 0 THEN '{W.REASONS['colour']}' END, CASE WHEN colour > 0 THEN {S.mapped('hue', W.COLOUR_SHOWN)} END, "
    f"CASE WHEN sweet > 0 THEN '{W.REASONS['sweet']}' END, CASE WHEN sweet > 0 THEN {S.mapped('sweetness', W.SWEET_SHOWN)} END, CASE WHEN brand > 0 THEN '{W.REASONS['brand']}' END, "
    f"CASE WHEN taste > 0 THEN '{W.REASONS['taste']}' END, CASE WHEN region > 0 THEN '{W.REASONS['region']}' END)"
)


@query(f"""
WITH q AS (SELECT s.cache_id, s.colour, {_ONE_SWEET} AS sweetness, s.grapes, s.tastes, {_BRANDS} AS brands, list_distinct({S.tokens('e.region')}) AS regions FROM {_sql_signals(_ASKED, 'cache_id', _PAGE_TEXT)} s JOIN external_cache e USING (cache_id)),
k AS (SELECT q.cache_id, c.row_idx, q.colour AS hue, q.sweetness, len(list_intersect(q.grapes, c.grapes)) AS grape, coalesce((q.colour = c.colour)::INT, 0) AS colour, coalesce((q.sweetness = c.sweetness)::INT, 0) AS sweet,
  list_has_any(q.brands, c.brands)::INT AS brand, len(list_intersect(q.tastes, c.tastes)) AS taste, len(list_intersect(q.regions, c.regions)) AS region FROM q CROSS JOIN {_CARDS} c),
o AS (SELECT *, row_number() OVER (PARTITION BY cache_id ORDER BY grape DESC, colour DESC, sweet DESC, brand DESC, taste DESC, region DESC, row_idx) AS rn FROM k WHERE grape + colour + sweet + brand + taste + region > 0),
p AS (SELECT *, CASE WHEN rn = 1 THEN 1 WHEN rn = min(rn) FILTER (colour > 0) OVER w THEN 2 WHEN rn = min(rn) FILTER (brand > 0) OVER w THEN 3 WHEN rn = min(rn) FILTER (grape > 0) OVER w THEN 4 ELSE 4 + rn END AS pr FROM o WINDOW w AS (PARTITION BY cache_id))
SELECT cache_id, row_idx, row_number() OVER (PARTITION BY cache_id ORDER BY pr) AS place, {_REASONS} AS reason FROM p QUALIFY row_number() OVER (PARTITION BY cache_id ORDER BY pr) <= 4""")
def attribute_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The four cards nearest to every twentieth found page by attributes, with the reason in words."""
    pages = table(spark, folder, "external_cache").where("status = 'found' and cache_id % 20 = 0")
    profiles = cut(G.profile_signals(pages, "cache_id", page_text(), grapes(spark, folder)))
    out = G.rank_by_attributes(profiles, G.card_signals(catalog(spark, folder)), "cache_id", "row_idx").join(profiles.select("cache_id", F.col("colour").alias("hue"), "sweetness"), "cache_id")
    said = lambda k: F.when(F.col(k) > 0, W.REASONS[k])
    parts = [said("grape"), said("colour"), F.when(F.col("colour") > 0, L.lookup(F.col("hue"), W.COLOUR_SHOWN)), said("sweet"), F.when(F.col("sweet") > 0, L.lookup(F.col("sweetness"), W.SWEET_SHOWN)), said("brand"), said("taste"), said("region")]
    return out.select("cache_id", "row_idx", F.col("place").cast("long").alias("place"), F.concat_ws(", ", *parts).alias("reason"))


_LAST = "(SELECT trace_id, max_by(struct_pack(ocr := ocr, method := method, winner_slug := winner_slug, visual := visual, final_score := final_score, neighbors := neighbors), logged_at) AS r FROM recognition_trace GROUP BY 1)"
_REQ = f"(SELECT trace_id, r.ocr AS ocr, r.method AS method, r.winner_slug AS winner_slug, r.visual AS visual, r.final_score AS final_score, r.neighbors AS neighbors FROM {_LAST})"
_USEFUL = f"list_filter({S.tokens('ocr')}, lambda t: length(t) >= 5 AND NOT {S.generic('t')})"
_AGREE = "CASE WHEN q.{f} IS NULL OR c.{f} IS NULL THEN 0 WHEN q.{f} = c.{f} THEN {same} ELSE {other} END"
_BONUS = (
    _AGREE.format(f="colour", same=G.COLOUR_SAME, other=G.COLOUR_OTHER) + " + " + _AGREE.format(f="sweetness", same=G.SWEET_SAME, other=G.SWEET_OTHER)
    + f" + CASE WHEN len(q.grapes) > 0 AND len(c.grapes) > 0 THEN {G.GRAPE_SHARE} * len(list_intersect(q.grapes, c.grapes)) / len(q.grapes) ELSE 0 END + CASE WHEN list_has_any(q.useful, c.makers) THEN {G.MAKER_NAMED} ELSE 0 END"
    + f" + CASE WHEN list_has_any(q.useful, c.regions) THEN {G.REGION_NAMED} ELSE 0 END + least({G.TASTE_MOST}, {G.TASTE_SHARED} * len(list_intersect(q.tastes, c.tastes)))"
)
_SIGNED = f"(SELECT s.trace_id, s.colour, {_ONE_SWEET} AS sweetness, s.grapes, s.tastes, {_USEFUL.replace('ocr', 's.said')} AS useful FROM {_sql_signals(_REQ, 'trace_id', 'ocr')} s)"
_REASON3 = f"concat_ws(', ', CASE WHEN q.colour = c.colour THEN '{W.REASONS['colour']}' END, CASE WHEN list_has_any(q.grapes, c.grapes) THEN '{W.REASONS['grape']}' END, CASE WHEN q.sweetness = c.sweetness THEN '{W.REASONS['sweet']}' END, '{W.REASONS['visual']}')"


def requests(spark: SparkSession, folder: str, cols: tuple[str, ...] = ("ocr", "method", "winner_slug", "visual", "final_score", "neighbors")) -> DataFrame:
    """The last report of each request, only the named columns of it."""
    return table(spark, folder, "recognition_trace").groupBy("trace_id").agg(F.max_by(F.struct(*cols), "logged_at").alias("r")).select("trace_id", "r.*")


def asked_signals(spark: SparkSession, folder: str, last: DataFrame) -> DataFrame:
    """(trace_id, q): the signals of each request with its telling words."""
    useful = F.filter(T.tokens("ocr"), lambda t: (F.length(t) >= 5) & ~T.is_generic(t))
    s = G.text_signals(last, "trace_id", F.col("ocr"), grapes(spark, folder)).join(last.select("trace_id", useful.alias("useful")), "trace_id")
    return s.select("trace_id", F.struct("colour", "sweetness", "grapes", "tastes", "useful").alias("q"))


def card_structs(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, c): the attributes of each card."""
    c = G.card_signals(catalog(spark, folder))
    return cut(c.select("slug", F.struct(*[x for x in c.columns if x != "slug"]).alias("c")))


@query(f"""
WITH q AS {_SIGNED}, n AS (SELECT trace_id, generate_subscripts(neighbors, 1) AS pos, unnest(neighbors) AS n FROM {_REQ}), m AS (SELECT trace_id, min(pos) AS pos, n.slug AS slug FROM n WHERE n.slug IS NOT NULL GROUP BY 1, 3),
j AS (SELECT m.trace_id, m.pos, m.slug, coalesce(n.n.visual, 0) AS v, coalesce(n.n.visual, 0) + round({_BONUS}, 9) AS score, {_REASON3} AS reason FROM m JOIN n ON n.trace_id = m.trace_id AND n.pos = m.pos JOIN q ON q.trace_id = m.trace_id JOIN {_CARDS} c ON c.slug = m.slug)
SELECT trace_id, slug, round(score, 6) AS score, reason, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, v DESC, pos) AS place FROM j""")
def similar_list(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of each request by their score with what their attributes add, with the reason in words."""
    last = requests(spark, folder)
    near = last.select("trace_id", F.posexplode("neighbors").alias("pos", "n")).where("n.slug is not null").groupBy("trace_id", F.col("n.slug").alias("slug")).agg(F.min(F.struct("pos", F.coalesce("n.visual", F.lit(0.0)).alias("v"))).alias("p"))
    j = join_even(near.select("trace_id", "slug", "p.pos", "p.v"), card_structs(spark, folder), "slug").join(asked_signals(spark, folder, last), "trace_id")
    q, c = F.col("q"), F.col("c")
    said = lambda cond, k: F.when(cond, W.REASONS[k])
    reason = F.concat_ws(", ", said(q["colour"] == c["colour"], "colour"), said(F.arrays_overlap(q["grapes"], c["grapes"]), "grape"), said(q["sweetness"] == c["sweetness"], "sweet"), F.lit(W.REASONS["visual"]))
    scored = j.select("trace_id", "slug", "pos", "v", (F.col("v") + F.round(G.bonus("q", "c"), 9)).alias("score"), reason.alias("reason"))
    # at most as many neighbours a request as it reports
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("v")).alias("v"), "pos", "slug", "reason")))
    out = scored.groupBy("trace_id").agg(ranked.alias("r")).select("trace_id", F.posexplode("r").alias("at", "r"))
    return out.select("trace_id", "r.slug", F.round(-F.col("r.s"), 6).alias("score"), "r.reason", (F.col("at") + 1).cast("long").alias("place"))


_KINDS = f"""(SELECT trace_id, count(DISTINCT token) FILTER (kind = 'grape' AND token NOT IN ({S.quoted(W.COMMON_GRAPES)})) AS g, count(DISTINCT token) FILTER (kind = 'grape') AS every_g, count(DISTINCT token) FILTER (kind = 'winery') AS w, count(DISTINCT token) FILTER (kind = 'name') AS n, count(DISTINCT token) AS words
FROM (SELECT trace_id, unnest({S.tokens('ocr')}) AS token FROM {_REQ}) JOIN {_LEXICON} USING (token) GROUP BY 1)"""
_STEM = "regexp_replace({0}, '-[0-9]{{1,2}}$', '')"
_FLATNAME = "lower(trim(regexp_replace(coalesce({0}, ''), '\\\\s+', ' ', 'g')))"
_SAME = f"(({_STEM.format('a.slug')} = {_STEM.format('b.slug')} AND a.slug <> '' AND {_STEM.format('a.slug')} <> '') OR ({_FLATNAME.format('a.name')} <> '' AND {_FLATNAME.format('a.name')} = {_FLATNAME.format('b.name')}))"
_LEADS = {k: v.replace("1.0D", "1.0") for k, v in D.LEADS.items()}


@query(f"""
WITH q AS {_SIGNED}, c AS {_CARDS}, a AS (SELECT r.*, c.slug, c.name, c.colour AS c_colour, c.grapes AS c_grapes FROM {_REQ} r JOIN c ON c.slug = r.winner_slug),
x AS (SELECT a.trace_id, min(u.pos) AS pos FROM a, (SELECT trace_id, generate_subscripts(neighbors, 1) AS pos, unnest(neighbors) AS n FROM {_REQ}) u, c b WHERE u.trace_id = a.trace_id AND b.slug = u.n.slug AND NOT {_SAME} GROUP BY 1),
t AS (SELECT a.trace_id, method, coalesce(final_score, visual, 0) AS top, coalesce(visual, 0) AS visual, CASE WHEN x.pos IS NOT NULL THEN coalesce(neighbors[x.pos].visual, 0) END AS second_visual, CASE WHEN x.pos IS NOT NULL THEN 0.9 * coalesce(neighbors[x.pos].visual, 0) END AS second,
  coalesce(n, 0) + coalesce(g, 0) >= 2 AS exclusive, len(neighbors) AS size, coalesce(words, 0) AS words, coalesce(every_g, 0) > 0 AND coalesce(g, 0) = 0 AND coalesce(w, 0) = 0 AND coalesce(n, 0) = 0 AS generic, coalesce(w, 0) > 0 AND coalesce(n, 0) = 0 AND coalesce(g, 0) = 0 AS house,
  coalesce(q.colour <> c_colour, false) OR (len(q.grapes) > 0 AND len(c_grapes) > 0 AND NOT list_has_any(q.grapes, c_grapes)) AS conflicts FROM a LEFT JOIN x USING (trace_id) LEFT JOIN q USING (trace_id) LEFT JOIN {_KINDS} k USING (trace_id)),
l AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _LEADS.items())} FROM t)
SELECT trace_id, CAST({D.sql_case(False)} AS INT) AS rule, {D.sql_case(True)} AS accepted FROM l""")
def match_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each request's leader is meant, by the first rule that fits: scores, lead over the first different card, agreement of
    attributes and what the text's known words are."""
    last = cut(requests(spark, folder))
    cards = card_structs(spark, folder).join(catalog(spark, folder).select("slug", "name"), "slug")
    led = join_even(last.where("winner_slug is not null").withColumnRenamed("winner_slug", "slug"), cut(cards), "slug")
    near = led.select("trace_id", F.col("slug").alias("a_slug"), F.col("name").alias("a_name"), F.posexplode("neighbors").alias("pos", "n")).select("trace_id", "a_slug", "a_name", "pos", F.col("n.slug").alias("slug"), F.coalesce("n.visual", F.lit(0.0)).alias("v")).where("slug is not null")
    other = join_even(near, cards.select("slug", "name"), "slug").where(~G.same_listing(F.col("a_slug"), F.col("a_name"), F.col("slug"), F.col("name"))).groupBy("trace_id").agg(F.min_by("v", "pos").alias("second_visual"))
    tokens = last.select("trace_id", F.explode(F.array_distinct(T.tokens("ocr"))).alias("token"))
    known = join_even(tokens, lexicon(spark, folder), "token").groupBy("trace_id").agg(
        F.count_if((F.col("kind") == "grape") & ~F.col("token").isin(*W.COMMON_GRAPES)).alias("g"), F.count_if(F.col("kind") == "grape").alias("every_g"), F.count_if(F.col("kind") == "winery").alias("w"), F.count_if(F.col("kind") == "name").alias("n"), F.count("*").alias("words")
    )
    j = led.join(other, "trace_id", "left").join(asked_signals(spark, folder, last), "trace_id", "left").join(known, "trace_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = j.select(
        "trace_id", "method", F.coalesce("final_score", "visual", F.lit(0.0)).alias("top"), F.coalesce("visual", F.lit(0.0)).alias("visual"), "second_visual", (0.9 * F.col("second_visual")).alias("second"),
        (zero("n") + zero("g") >= 2).alias("exclusive"), F.size("neighbors").alias("size"), zero("words").alias("words"), ((zero("every_g") > 0) & (zero("g") == 0) & (zero("w") == 0) & (zero("n") == 0)).alias("generic"),
        ((zero("w") > 0) & (zero("n") == 0) & (zero("g") == 0)).alias("house"), F.coalesce(G.conflicts("q", "c"), F.lit(False)).alias("conflicts"),
    )
    return D.with_leads(t).select("trace_id", D.rule().alias("rule"), D.accepted().alias("accepted"))
