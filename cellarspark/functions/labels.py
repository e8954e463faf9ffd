"""What the words of a label mean: colour, sweetness, grapes, readings of misread words.  Column functions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.functions import words as W
from cellarspark.sources.tables import cell

VOWELS = "АЕИОУЫЭЮЯAEIOUY"


def lookup(c: Column, values: dict[str, str]) -> Column:
    """The value of a word, NULL if it has none."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def near(c: Column, target: str, least: float = 0.80) -> Column:
    """Whether a word of five letters or more nearly spells the target, which is at most one letter longer or shorter."""
    return (F.length(c) >= 5) & (F.abs(F.length(c) - len(target)) <= 1) & (T.indel_ratio(c, F.lit(target)) >= least)


def brut_misread(c: Column) -> Column:
    """Whether the word, or its letters as Latin ones, is a reading of BRUT."""
    raw = F.upper(F.coalesce(c, F.lit("")))
    latin = F.regexp_replace(F.translate(raw, W.LOOK_CYRILLIC, W.LOOK_LATIN), "[^A-ZА-Я]", "")
    return (F.regexp_replace(raw, "[^А-Я]", "") == "БРЮТ") | latin.isin(*W.BRUT_FORMS)


def forms(c: Column) -> Column:
    """The word, its mixed look-alikes folded, and for Latin words every look-alike as Cyrillic; each once."""
    ascii_form = F.when(c.rlike("^[\\x00-\\x7F]*$"), F.translate(c, W.LOOK_LATIN, W.LOOK_CYRILLIC))
    return F.array_distinct(F.filter(F.array(c, T.fold_homoglyphs(c), ascii_form), lambda f: f.isNotNull()))


def _first(items: Column, value) -> Column:  # noqa: ANN001
    """The first value that is not NULL over an array."""
    return F.get(F.filter(F.transform(items, value), lambda v: v.isNotNull()), F.lit(0))


#: words that a misread word of colour or sweetness may nearly spell
NEAR_WORDS = ("КРАСНОЕ", "КРАСНЫЙ", "БЕЛОЕ", "БЕЛЫЙ", "РОЗОВОЕ", "РОЗОВЫЙ", "ОРАНЖЕВОЕ", "СУХОЕ", "СУХОЙ", "СЛАДКОЕ", "СЛАДКИЙ", "ПОЛУСЛАДКОЕ", "ПОЛУСУХОЕ", "БРЮТ")


def colour_of_word(c: Column, known_grape: Column, close: Column | None = None) -> Column:
    """white, red, rose or orange; NULL for other words, among them grapes whose names begin like a colour.

    `close` has those of NEAR_WORDS that the word nearly spells; without it they are found here, which costs more.
    """
    near_ = (lambda x, w: near(x, w)) if close is None else (lambda x, w: F.array_contains(close, w))

    def plain(f: Column) -> Column:
        return (
            F.when(lookup(f, W.COLOUR_WORDS).isNotNull(), lookup(f, W.COLOUR_WORDS))
            .when(F.startswith(f, F.lit("ОРАНЖ")) | F.startswith(f, F.lit("ORANGE")), "orange")
            .when(f == "WHITE", "white").when(f == "RED", "red").when(f == "ROSE", "rose")
        )

    barred = known_grape | F.contains(c, F.lit("СТОП")) | F.startswith(c, F.lit("КРАСНОСТ")) | F.startswith(c, F.lit("КРАСНА"))
    guessed = (
        F.when(barred, F.lit(None).cast("string")).when(near_(c, "КРАСНОЕ") | near_(c, "КРАСНЫЙ"), "red").when(near_(c, "БЕЛОЕ") | near_(c, "БЕЛЫЙ"), "white")
        .when(near_(c, "РОЗОВОЕ") | near_(c, "РОЗОВЫЙ"), "rose").when(near_(c, "ОРАНЖЕВОЕ"), "orange")
    )
    return F.coalesce(_first(forms(c), plain), guessed)


def sweetness_of_word(c: Column, close: Column | None = None) -> Column:
    """dry, sweet, semi_dry, semi_sweet or brut; NULL for other words; `close` as in `colour_of_word`."""
    near_ = (lambda x, w: near(x, w)) if close is None else (lambda x, w: F.array_contains(close, w))

    def plain(f: Column) -> Column:
        return (
            F.when(lookup(f, W.SWEET_WORDS).isNotNull(), lookup(f, W.SWEET_WORDS)).when(f == "DRY", "dry").when(f == "SWEET", "sweet")
            .when(f.rlike("^(ПОЛУСЛАД|POLUSLAD)"), "semi_sweet").when(f.rlike("^(ПОЛУСУХ|POLUSUH)"), "semi_dry")
        )

    guessed = (
        F.when(near_(c, "СУХОЕ") | near_(c, "СУХОЙ"), "dry").when(near_(c, "СЛАДКОЕ") | near_(c, "СЛАДКИЙ"), "sweet")
        .when(near_(c, "ПОЛУСЛАДКОЕ"), "semi_sweet").when(near_(c, "ПОЛУСУХОЕ"), "semi_dry").when(near_(c, "БРЮТ"), "brut")
    )
    return F.when(brut_misread(c), "brut").otherwise(F.coalesce(_first(forms(c), plain), guessed))


def repair_reading(c: Column) -> Column:
    """Latin look-alikes as Cyrillic, J as Л, and 3 as З unless the word is a number."""
    folded = F.translate(c, W.LOOK_LATIN + "J", W.LOOK_CYRILLIC + "Л")
    return F.when(F.translate(folded, "ОI", "01").rlike("^[0-9]+$"), folded).otherwise(F.replace(folded, F.lit("3"), F.lit("З")))


def near_filler(c: Column, least: float = 0.84) -> Column:
    """Whether a word of five letters or more is no filler but nearly spells one."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(W.NAME_STOP)])
    close = F.exists(stop, lambda s: (F.abs(F.length(s) - F.length(c)) <= 1) & (T.indel_ratio(c, s) >= least))
    return F.when((F.length(c) < 5) | c.isin(*W.NAME_STOP), F.lit(False)).otherwise(close)


def readable(c: Column, filler: Column | None = None) -> Column:
    """Whether a word can be said: letters only, enough vowels, no four consonants in a row, no filler and none nearly
    (`filler`, found here if it is not given)."""
    vowels = T.letters_in(c, VOWELS)
    said = (F.length(c) >= 4) & c.rlike("^[A-ZА-Я]+$") & (vowels >= 1) & ((F.length(c) < 6) | (vowels >= 2)) & ~c.rlike(f"[^{VOWELS}]{{4,}}")
    return (c == "ДОЛИНА") | F.when(said, ~T.is_generic(c) & ~(near_filler(c) if filler is None else filler)).otherwise(F.lit(False))


def word_script(c: Column) -> Column:
    """lat for a word with letters only Latin has and none only Cyrillic has, else cyr."""
    v = T.votes(c)
    return F.when((v["latin"] > 0) & (v["cyrillic"] == 0), "lat").otherwise("cyr")


def mostly_latin(c: Column) -> Column:
    """Whether unambiguous letters, else look-alike ones, vote for Latin."""
    v = T.votes(c)
    return F.when(v["cyrillic"] != v["latin"], v["latin"] > v["cyrillic"]).otherwise(v["look_latin"] > v["look_cyrillic"])


def latin_reading(c: Column) -> Column:
    """The Latin spelling of a word that has a letter no Cyrillic one looks like, NULL for others or where nothing changes."""
    folded = F.translate(c, W.LOOK_CYRILLIC, W.LOOK_LATIN)
    return F.when(c.rlike(f"[{W.DISTINCT_LATIN}]") & (folded != c), folded)


def common_grape(c: Column) -> Column:
    """Whether a word, or what it is another spelling of, is a grape of dozens of labels."""
    alias = lookup(c, W.CLIPPED_GRAPES | W.LATIN_GRAPES)
    return c.isin(*W.COMMON_GRAPES) | F.coalesce(alias.isin(*W.COMMON_GRAPES), F.lit(False))


def grape_alias(c: Column) -> Column:
    """The grape's word that this is another spelling of, NULL if none."""
    return F.coalesce(lookup(c, W.LATIN_GRAPES), lookup(c, W.CLIPPED_GRAPES))


def recovered_noir(tokens: Column) -> Column:
    """Words that a text implies: ПИНО and НУАР by ПО beside a rest of НУАР, НУАР by a gated reading beside a word for ПИНО."""
    has = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return F.when(F.array_contains(tokens, "ПО") & has(W.NOIR_STEMS), F.array(F.lit("ПИНО"), F.lit("НУАР"))).when(has(W.PINOT_MARKS) & has(W.NOIR_GATED), F.array(F.lit("НУАР"))).otherwise(F.array().cast("array<string>"))


def twin_key(c: Column) -> Column:
    """One key for look-alike spellings of a word."""
    return F.lower(F.translate(F.upper(c), W.LOOK_CYRILLIC, W.LOOK_LATIN))


def asked_word(c: Column) -> Column:
    """Whether a word belongs into a lookup: no number, no filler, no reading of BRUT."""
    return (c != "") & ~c.rlike("^[0-9]+$") & ~brut_misread(c) & ((c == "ДОЛИНА") | ~T.is_generic(c))


def shown_word(c: Column) -> Column:
    """A word with one capital; words of style in small letters."""
    low = F.lower(F.trim(c))
    return F.when(low == "ultra", "Ultra").when(low.isin(*W.STYLE_WORDS), low).otherwise(F.concat(F.substring(F.trim(c), 1, 1), F.lower(F.substring(F.trim(c), 2, 1_000_000))))


def shown_grapes(grapes: Column) -> Column:
    """Grape words in one line, pairs that are one variety joined."""
    pairs = F.create_map(*[F.lit(x) for (a, b), v in W.GRAPE_PAIRS.items() for x in (f"{a} {b}", v)])
    upper = F.transform(grapes, lambda g: F.upper(g))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        pair = pairs[F.concat(F.get(upper, i), F.lit(" "), F.coalesce(F.get(upper, i + 1), F.lit("")))]
        taken = F.when(acc["skip"] == 1, acc["out"]).otherwise(F.array_append(acc["out"], F.coalesce(pair, shown_word(F.get(grapes, i)))))
        return F.struct(F.when((acc["skip"] == 0) & pair.isNotNull(), 1).otherwise(0).alias("skip"), taken.alias("out"))

    each = F.when(F.size(grapes) > 0, F.sequence(F.lit(0), F.size(grapes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, start, step, lambda acc: F.array_join(F.filter(acc["out"], lambda x: x != ""), ", "))


def taste_notes(c: Column | str) -> Column:
    """The first five tastes a text names, in words."""
    words = dict(zip(W.TASTE_STEMS, W.TASTE_WORDS))
    return F.array_join(F.slice(F.transform(T.stems_found(c, W.TASTE_STEMS), lambda s: lookup(s, words)), 1, 5), ", ")


def food_labels(c: Column | str) -> Column:
    """The kinds of food a text names."""
    return F.transform(T.stems_found(c, [s for s, _ in W.FOOD_STEMS]), lambda s: lookup(s, dict(W.FOOD_STEMS)))


def plain_words(c: Column | str) -> Column:
    """Runs of three letters or more in capitals, ё as е."""
    return F.regexp_extract_all(F.translate(F.upper(F.coalesce(T.column(c), F.lit(""))), "Ё", "Е"), F.lit("[A-ZА-Я]{3,}"), F.lit(0))


def content_words(c: Column | str) -> Column:
    """Words of four letters or more that say something, each once."""
    stop = F.array(*[F.lit(w) for w in W.ASK_STOP])
    return F.array_distinct(F.filter(plain_words(c), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)))


def overlap_count(ask: Column | str, *cells: Column | str) -> Column:
    """How many beginnings (three letters) of an ask's content words begin a word of the cells."""
    stems = lambda words: F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 3)))
    hay = plain_words(F.concat_ws(" ", *[T.column(x) for x in cells]))
    return F.size(F.array_intersect(stems(content_words(ask)), stems(hay)))


def too_short(c: Column | str, least: int = 3) -> Column:
    """Whether an ask has fewer characters than `least` once its blanks are joined."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(T.column(c), F.lit("")), "\\s+", " "))) < least


def style_words(tokens: Column) -> Column:
    """Line, colour and sweetness words of a label for a lookup, in this order, each once."""
    ultra = lambda t: t.isin("ULTRA", "УЛЬТРА") | ((F.abs(F.length(t) - 6) <= 1) & (T.indel_ratio(t, F.lit("УЛЬТРА")) >= 0.80))
    orange = lambda t: (F.abs(F.length(t) - 5) <= 1) & (T.indel_ratio(t, F.lit("ОРАНЖ")) >= 0.80)
    line = lambda t: F.array(F.when(ultra(t), "Ultra"), F.when(t.isin("CUVEE", "CUVE", "КЮВЕ"), "кюве"))
    colour = lambda t: F.array(F.coalesce(lookup(t, W.COLOUR_ASKED), F.when(orange(t), "оранж")))
    sweet = lambda t: F.array(F.when(brut_misread(t), "брют").otherwise(lookup(t, W.SWEET_ASKED)))
    each = F.concat(*[F.flatten(F.transform(tokens, f)) for f in (line, colour, sweet)])
    return F.array_distinct(F.filter(each, lambda w: w.isNotNull()))


def number(c: Column | str, default: float = 0.0) -> Column:
    """A cell as a number, the default where it is none."""
    return F.coalesce(T.column(c).try_cast("double"), F.lit(default))


def grape_key(c: Column | str) -> Column:
    """The first part of a grape cell with four letters or more, else the whole, in small letters."""
    low = F.translate(F.lower(cell(c)), "ё", "е")
    return F.coalesce(F.get(F.filter(F.split(low, "[,;\\s]+"), lambda x: F.length(x) >= 4), F.lit(0)), low)
