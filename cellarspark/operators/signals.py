"""Signals of texts, profiles and cards: colour, sweetness, grapes, tastes, makers, regions; and ranking by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarspark.functions import labels as L
from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.operators import fuzzy
from cellarspark.plans.lineage import cut

STRINGS = "array<string>"


def near_fillers(words: DataFrame) -> DataFrame:
    """(word): the distinct words of five letters or more that are no filler but nearly spell one."""
    stop = words.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(W.NAME_STOP)], "entry string")
    asked = words.where((F.length("word") >= 5) & ~F.col("word").isin(*W.NAME_STOP))
    return fuzzy.near_pairs(asked, stop, "word", "entry", 0.84, 1).select("word").distinct()


def class_words(words: DataFrame, grapes: DataFrame) -> DataFrame:
    """(word, colour, sweet): the colour and sweetness each distinct word means; words that are grapes are no colours."""
    once = words.select("word").where("word is not null and word <> ''").distinct()
    targets = words.sparkSession.createDataFrame([(w,) for w in L.NEAR_WORDS], "target string")
    close = fuzzy.near_pairs(once.where(F.length("word") >= 5), targets, "word", "target", 0.80, 1).groupBy("word").agg(F.collect_list("target").alias("close"))
    known = grapes.select(F.col("grape").alias("word"), F.lit(True).alias("known")).distinct()
    j = once.join(close, "word", "left").join(known, "word", "left").withColumn("close", F.coalesce("close", F.array().cast(STRINGS)))
    return j.select("word", L.colour_of_word(F.col("word"), F.coalesce("known", F.lit(False)), F.col("close")).alias("colour"), L.sweetness_of_word(F.col("word"), F.col("close")).alias("sweet"))


def resolve_grapes(words: DataFrame, grapes: DataFrame) -> DataFrame:
    """(word, grape, quality): the grape each distinct word of `words` (word) means among `grapes` (grape).

    By its other spelling, itself, the one grape it begins (six letters or more, at most four short), or the nearest grape with
    a lead; words that nearly spell a filler are none unless they are another spelling.  NULL and '' mean none.
    """
    asked = words.select("word").where("word is not null and word <> ''").distinct().where(~F.col("word").isin(*W.GRAPE_STOP))
    known = grapes.select("grape").where("grape is not null and grape <> ''").distinct()
    free = known.where(~F.col("grape").isin(*W.GRAPE_STOP))
    alias = asked.select("word", L.grape_alias(F.col("word")).alias("grape")).join(free, "grape").select("word", "grape", F.lit("alias").alias("quality"), F.lit(1).alias("o"))
    plain = cut(asked.where(F.length("word") >= 4).join(near_fillers(asked), "word", "left_anti"))
    exact = plain.join(known.withColumn("word", F.col("grape")), "word").select("word", "grape", F.lit("exact").alias("quality"), F.lit(2).alias("o"))
    longer = fuzzy.unique_affix(plain, free.select("grape", F.col("grape").alias("target")), "word", "grape", "target", 6, 4, strict=True)
    prefix = longer.select("word", F.col("target").alias("grape"), F.lit("prefix").alias("quality"), F.lit(3).alias("o"))
    close = fuzzy.margin_match(plain.where(F.length("word") >= 5), free.where(F.length("grape") >= 4), "word", "grape", 0.90, 0.04)
    fuzz = close.select("word", "grape", F.lit("fuzzy").alias("quality"), F.lit(4).alias("o"))
    every = alias.unionByName(exact).unionByName(prefix).unionByName(fuzz)
    return every.groupBy("word").agg(F.min(F.struct("o", "grape", "quality")).alias("r")).select("word", "r.grape", "r.quality")


def text_signals(df: DataFrame, key: str, text: Column, grapes: DataFrame) -> DataFrame:
    """(key, colour, sweetness, grapes, tastes) of one text a key; NULL where a text names no or several colours or sweetnesses.

    Words are classed once each, whatever the number of texts that use them.
    """
    said = df.select(key, text.alias("said"))
    tokens = said.select(key, F.posexplode(T.tokens("said")).alias("pos", "word"))
    words = cut(tokens.select("word").distinct())
    classed = class_words(words, grapes).join(resolve_grapes(words, grapes), "word", "left")
    telling = classed.where("colour is not null or sweet is not null or grape is not null")
    met = tokens.join(telling, "word")
    found = met.groupBy(key).agg(F.min("colour").alias("lo"), F.max("colour").alias("hi"), F.collect_set("sweet").alias("sweets"), F.array_sort(F.collect_list(F.when(F.col("grape").isNotNull(), F.struct("pos", "grape")))).alias("g"))
    told = T.sweetness(F.replace(F.col("said"), F.lit("-"), F.lit(" ")))
    out = said.join(found, key, "left").withColumn("told", told)
    sweets = F.array_distinct(F.concat(F.coalesce("sweets", F.array().cast(STRINGS)), F.when(F.col("told").isNotNull(), F.array("told")).otherwise(F.array().cast(STRINGS))))
    ordered = F.array_distinct(F.transform(F.coalesce("g", F.expr("cast(array() as array<struct<pos:int,grape:string>>)")), lambda x: x["grape"]))
    return out.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("colour"), F.when(F.size(sweets) == 1, sweets[0]).alias("sweetness"), ordered.alias("grapes"), T.stems_found("said", W.TASTE_STEMS).alias("tastes"))


def profile_signals(pages: DataFrame, key: str, text: Column, grapes: DataFrame) -> DataFrame:
    """`text_signals` of profiles with their makers' telling words (`brands`) and their regions' words (`regions`)."""
    brands = F.array_distinct(F.filter(T.tokens("winery"), lambda t: (F.length(t) >= 4) & ~T.is_generic(t)))
    own = pages.select(key, brands.alias("brands"), F.array_distinct(T.tokens("region")).alias("regions"))
    return text_signals(pages, key, text, grapes).join(own, key)


def card_signals(catalog: DataFrame) -> DataFrame:
    """(row_idx, slug, colour, sweetness, grapes, tastes, makers, regions, brands) of every card of a catalog with one row a slug."""
    grapes = cut(catalog.select(F.explode(T.tokens("grape")).alias("grape")).distinct())
    words = catalog.select("row_idx", F.posexplode(T.tokens("grape")).alias("pos", "word"))
    met = words.join(resolve_grapes(words, grapes), "word").groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "grape"))).alias("g"))
    blank = lambda c: F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
    flat = lambda c: F.replace(c, F.lit("-"), F.lit(" "))
    sweet = F.coalesce(T.sweetness(flat(F.concat_ws(" ", blank("name"), blank("slug")))), T.sweetness(flat(F.col("description"))))
    brands = T.tokens(F.concat_ws(" ", blank("name"), blank(flat(F.col("slug"))), blank("winery")))
    ordered = F.array_distinct(F.transform(F.coalesce("g", F.expr("cast(array() as array<struct<pos:int,grape:string>>)")), lambda x: x["grape"]))
    return catalog.join(met, "row_idx", "left").select(
        "row_idx", "slug", T.colour_class("category", "slug").alias("colour"), sweet.alias("sweetness"), ordered.alias("grapes"), T.stems_found("description", W.TASTE_STEMS).alias("tastes"),
        F.array_distinct(T.tokens("winery")).alias("makers"), F.array_distinct(T.tokens("region")).alias("regions"), F.array_distinct(brands).alias("brands"),
    )


def _attributes(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, value): the attributes of signals, one a row."""
    one = lambda c, kind: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")))).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string>>)"))
    many = lambda c, kind: F.transform(F.array_distinct(c), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    parts = [one("colour", "colour"), one("sweetness", "sweet"), many("grapes", "grape"), many("tastes", "taste"), many("brands", "brand"), many("regions", "region")]
    return df.select(key, F.explode(F.concat(*parts)).alias("a")).select(key, "a.kind", "a.value")


#: kinds of attributes in the order in which they count, and the bits of their numbers
KINDS = {"grape": 14, "colour": 1, "sweet": 1, "brand": 1, "taste": 10, "region": 14}
#: cards that profiles meet at once (their place has 22 bits), and profiles that meet them
CARD_BLOCK, PROFILE_BLOCK = 50_000, 250


def _codes(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, codes): the numbers of the attributes that `known` (kind, value, code) has."""
    return _attributes(df, key).where(F.col(key).isNotNull()).join(known, ["kind", "value"]).groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("codes"))


class _Cards:
    """The attributes of a block of cards as the places of the cards that have them."""

    def __init__(self, codes: list[list[int]]) -> None:
        self.size = len(codes)
        flat = np.array([c for x in codes for c in x], dtype=np.int64)
        place = np.repeat(np.arange(self.size), [len(x) for x in codes])
        order = np.argsort(flat, kind="stable")
        keys, starts = np.unique(flat[order], return_index=True)
        self.places = dict(zip(keys.tolist(), np.split(place[order], starts[1:])))
        self.behind = (1 << 22) - 1 - np.arange(self.size)

    def nearest(self, codes: list[int], limit: int) -> list[tuple]:
        """(place, counts by kind) of the first cards in order, and of the first ones of the colour and the maker."""
        shift = dict(zip(KINDS, np.cumsum([0, *list(KINDS.values())[:0:-1]])[::-1].tolist()))
        names, total = list(KINDS), np.zeros(self.size, dtype=np.int64)
        for c in codes:
            if (at := self.places.get(c)) is not None:
                kind = names[c % len(names)]
                if KINDS[kind] == 1:
                    total[at] |= 1 << shift[kind]
                else:
                    total[at] += 1 << shift[kind]
        met = np.flatnonzero(total)
        if not len(met):
            return []
        order = total[met] << 22 | self.behind[met]
        found = set((np.partition(order, -limit)[-limit:] if len(order) > limit else order).tolist())
        for kind in ("colour", "brand", "grape"):
            of_kind = order[order >> 22 + shift[kind] & (1 << KINDS[kind]) - 1 > 0]
            if len(of_kind):
                found.add(int(of_kind.max()))
        return [((1 << 22) - 1 - (x & (1 << 22) - 1), *(x >> 22 + shift[k] & (1 << KINDS[k]) - 1 for k in KINDS)) for x in found]


def nearest_by_attributes(profiles: DataFrame, cards: DataFrame, key: str, row: str, limit: int) -> DataFrame:
    """(key, row, grape, colour, sweet, brand, taste, region): of each block of cards the `limit` first ones of each profile in
    the order of `rank_by_attributes`, and its first one of the profile's colour, of its maker and with one of its grapes.

    Of cards with the same attributes (among those that any profile has) only the `limit` smallest rows can come first.
    Blocks of cards meet bundles of profiles, so pairs are counted where they meet and are never shuffled.
    """
    number = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    known = cut(_attributes(profiles, key).select("kind", "value").where("value is not null").distinct().select("kind", "value", (F.monotonically_increasing_id() * len(KINDS) + number).alias("code")))
    asked = cut(_codes(profiles, key, known))
    if not asked.where(F.size("codes") >= (1 << KINDS["taste"]) - 1).isEmpty():
        wide = asked.select(F.explode("codes").alias("c"), key).groupBy(key, (F.col("c") % len(KINDS)).alias("k")).agg(F.count("*").alias("n"))
        if not wide.where(" or ".join(f"k = {i} and n >= {1 << b}" for i, (k, b) in enumerate(KINDS.items()) if k in ("grape", "taste", "region"))).isEmpty():
            raise ValueError("a profile has more grapes, tastes or regions than can be counted")
    few = Window.partitionBy("codes").orderBy(row)
    kept = cut(_codes(cards, row, known).withColumn("n", F.row_number().over(few)).where(F.col("n") <= limit).drop("n"))
    blocks = max(1, -(-kept.count() // CARD_BLOCK))
    block = kept.groupBy(F.pmod(F.xxhash64(row), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(row, "codes"))).alias("c")).select("block", F.col(f"c.{row}").alias("rows"), F.col("c.codes").alias("codes"))
    types = dict([*profiles.dtypes, *((f"card {n}", t) for n, t in cards.dtypes)])
    bundles = asked.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-asked.count() // PROFILE_BLOCK)))).alias("bundle")).agg(F.collect_list(F.struct(key, "codes")).alias("p")).select(F.col(f"p.{key}").alias("keys"), F.col("p.codes").alias("asked")).repartition(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, _Cards, pa.Array] | None = None
        for b in batches:
            for i in range(b.num_rows):
                number = b.column("block")[i].as_py()
                if last is None or last[0] != number:
                    last = (number, _Cards(b.column("codes")[i].as_py()), b.column("rows")[i].values)
                met = [(at, *x) for at, codes in enumerate(b.column("asked")[i].as_py()) for x in last[1].nearest(codes, limit)]
                at, place, *counts = zip(*met) if met else [()] * (2 + len(KINDS))
                yield pa.RecordBatch.from_arrays([b.column("keys")[i].values.take(pa.array(at, pa.int64())), last[2].take(pa.array(place, pa.int64())), *[pa.array(c, pa.int64()) for c in counts]], names=["key", "row", *KINDS])

    out = block.crossJoin(bundles).mapInArrow(meet, f"key {types[key]}, row {types[f'card {row}']}, " + ", ".join(f"{k} long" for k in KINDS))
    return out.select(F.col("key").alias(key), F.col("row").alias(row), *KINDS)


def rank_by_attributes(profiles: DataFrame, cards: DataFrame, key: str, row: str, limit: int = 4) -> DataFrame:
    """(key, row, place, grape, colour, sweet, brand, taste, region): the cards nearest to each profile by shared grapes, then
    colour, sweetness, maker, tastes and regions; ties go to the smaller row.

    The best card comes first, then the first one of the profile's colour, of its maker and with one of its grapes, then the
    rest in order.  Cards without a shared attribute are left out.
    """
    pairs = nearest_by_attributes(profiles, cards, key, row, limit)
    order = F.struct(*[(-F.col(k)).alias(k) for k in KINDS], F.col(row))
    # a few rows of each block
    near = pairs.select(key, order.alias("o")).groupBy(key).agg(F.min("o").alias("a"), *[F.min(F.when(F.col(f"o.{k}") < 0, F.col("o"))).alias(k) for k in ("colour", "brand", "grape")], F.array_sort(F.collect_list("o")).alias("best"))
    picked = F.array_distinct(F.filter(F.concat(F.array("a", "colour", "brand", "grape"), F.slice("best", 1, limit)), lambda o: o.isNotNull()))
    out = near.select(key, F.posexplode(F.slice(picked, 1, limit)).alias("place", "o"))
    return out.select(key, f"o.{row}", (F.col("place") + 1).alias("place"), *[(-F.col(f"o.{k}")).alias(k) for k in KINDS])


# ---- fixed values: what agreeing and differing attributes add to a candidate's score ----
COLOUR_SAME, COLOUR_OTHER, GRAPE_SHARE, SWEET_SAME, SWEET_OTHER = 0.18, -0.25, 0.16, 0.10, -0.08
MAKER_NAMED, REGION_NAMED, TASTE_SHARED, TASTE_MOST = 0.05, 0.04, 0.02, 0.06
# ---- end of fixed values ----


def bonus(asked: str, card: str) -> Column:
    """What a card's attributes add to its score for a request; `asked` and `card` are struct columns of signals, `asked` with
    the telling words of its text (`useful`)."""
    a, c = F.col(asked), F.col(card)
    agree = lambda f, same, other: F.when(a[f].isNull() | c[f].isNull(), 0.0).when(a[f] == c[f], same).otherwise(other)
    grapes = F.when((F.size(a["grapes"]) > 0) & (F.size(c["grapes"]) > 0), GRAPE_SHARE * F.size(F.array_intersect(a["grapes"], c["grapes"])) / F.size(a["grapes"])).otherwise(0.0)
    named = lambda f, w: F.when(F.arrays_overlap(a["useful"], c[f]), w).otherwise(0.0)
    tastes = F.least(F.lit(TASTE_MOST), TASTE_SHARED * F.size(F.array_intersect(a["tastes"], c["tastes"])))
    return agree("colour", COLOUR_SAME, COLOUR_OTHER) + agree("sweetness", SWEET_SAME, SWEET_OTHER) + grapes + named("makers", MAKER_NAMED) + named("regions", REGION_NAMED) + tastes


def conflicts(asked: str, card: str) -> Column:
    """Whether a request and a card name different colours, or grapes of which none is shared."""
    a, c = F.col(asked), F.col(card)
    colours = F.coalesce(a["colour"] != c["colour"], F.lit(False))
    return colours | F.coalesce((F.size(a["grapes"]) > 0) & (F.size(c["grapes"]) > 0) & ~F.arrays_overlap(a["grapes"], c["grapes"]), F.lit(False))


def same_listing(slug: Column, name: Column, other_slug: Column, other_name: Column) -> Column:
    """Whether two rows are one card: copies of one slug, or the same name."""
    flat = lambda n: F.lower(F.trim(F.regexp_replace(F.coalesce(n, F.lit("")), "\\s+", " ")))
    stems = F.coalesce((T.copy_stem(slug) == T.copy_stem(other_slug)) & (slug != "") & (T.copy_stem(slug) != ""), F.lit(False))
    return stems | ((flat(name) != "") & (flat(name) == flat(other_name)))
