"""Text functions over columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarspark.functions import words as W


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """Capitals, one form of look-alike signs (Ё, Ђ/Ћ, 0, 1), everything but letters and digits as one blank; NULL gives ''."""
    kept = F.regexp_replace(F.coalesce(column(c), F.lit("")), "[^A-Za-zА-Яа-яЁё0-9ЂЋђћ]+", " ")
    return F.trim(F.translate(F.upper(kept), "ЁЂЋ01", "ЕЬЬОI"))


def lower_normalize(c: Column | str) -> Column:
    """The small-letter variant: ё as е, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(column(c), F.lit(""))), "ё", "е"), "[^a-zа-я0-9]+", " "))


def letters_in(c: Column, letters: str) -> Column:
    """How many of the given letters a string has."""
    return F.length(c) - F.length(F.translate(c, letters, ""))


def votes(c: Column | str) -> dict[str, Column]:
    """latin, cyrillic, look_latin, look_cyrillic: how many letters of a word only one script has, and how many look alike."""
    c = column(c)
    latin_all, cyr_all = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
    only_latin = "".join(x for x in latin_all if x not in W.LOOK_LATIN)
    only_cyr = "".join(x for x in cyr_all if x not in W.LOOK_CYRILLIC)
    return {"latin": letters_in(c, only_latin), "cyrillic": letters_in(c, only_cyr), "look_latin": letters_in(c, W.LOOK_LATIN), "look_cyrillic": letters_in(c, W.LOOK_CYRILLIC)}


def script_votes(c: Column | str) -> Column:
    """The votes of a word as one struct."""
    return F.struct(*[v.alias(k) for k, v in votes(c).items()])


def mostly_cyrillic(c: Column | str) -> Column:
    """Whether unambiguous letters, else look-alike ones, vote for Cyrillic."""
    v = votes(c)
    return F.when(v["cyrillic"] != v["latin"], v["cyrillic"] > v["latin"]).otherwise(v["look_cyrillic"] > v["look_latin"])


def fold_homoglyphs(c: Column | str) -> Column:
    """Latin look-alikes of a mostly Cyrillic word as Cyrillic."""
    c = column(c)
    folded = F.translate(c, W.LOOK_LATIN, W.LOOK_CYRILLIC)
    return F.when((folded != c) & mostly_cyrillic(c), folded).otherwise(c)


def repair_digit(c: Column) -> Column:
    """A 3 before four letters or more is З."""
    return F.when(F.startswith(c, F.lit("3")) & c.rlike("^3[A-ZА-Я]{4,}$"), F.concat(F.lit("З"), F.substring(c, 2, 1_000_000))).otherwise(c)


def tokens(c: Column | str) -> Column:
    """Words of three letters or more; four or more single letters in a row are one word, words of two letters end such a row."""
    # single letters in a row come as one piece, other words each for itself
    pieces = F.regexp_extract_all(normalize(c), F.lit("(?<![^ ])[A-ZА-Я](?![^ ])(?: [A-ZА-Я](?![^ ]))*+|[^ ]+"), F.lit(0))
    kept = F.filter(pieces, lambda t: F.when(F.contains(t, F.lit(" ")), F.length(t) >= 7).otherwise(F.length(t) >= 3))
    return F.transform(kept, lambda t: repair_digit(fold_homoglyphs(F.replace(t, F.lit(" "), F.lit("")))))


def years(c: Column | str) -> Column:
    """Distinct years 19xx and 20xx in order, letters that stand for 0 and 1 read as digits."""
    parts = F.split(F.translate(normalize(c), "ОOI", "001"), " ")
    return F.array_distinct(F.filter(parts, lambda t: t.rlike("^(19|20)[0-9]{2}$")))


def short_text(c: Column | str, limit: int) -> Column:
    """Blank runs as one; longer texts are cut at the last blank within the limit, loose punctuation goes, '…' follows."""
    flat = F.trim(F.regexp_replace(F.coalesce(column(c), F.lit("")), "\\s+", " "))
    cut = F.regexp_replace(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), "[.,;:]+$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def copy_stem(c: Column | str) -> Column:
    """A slug without the number of its copy."""
    return F.regexp_replace(column(c), "-[0-9]{1,2}$", "")


def stems_found(c: Column | str, stems: list[str]) -> Column:
    """Those of the stems that the normalised text contains, in the stems' order."""
    # the text is normalised once, not once a stem
    found = F.transform(F.array(normalize(c)), lambda n: F.filter(F.array(*map(F.lit, stems)), lambda s: F.contains(n, s)))
    return found[0]


def sweetness(c: Column | str) -> Column:
    """The one sweetness that a text names, NULL for none or several. Longer stems are taken out before shorter ones are tried."""
    start = F.struct(normalize(c).alias("text"), F.array().cast("array<string>").alias("found"))
    stems = F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(v).alias("label")) for s, v in W.SWEET_STEMS])

    def step(acc: Column, s: Column) -> Column:
        hit = F.contains(acc["text"], s["stem"]) & ~F.array_contains(acc["found"], s["label"])
        return F.struct(F.when(hit, F.replace(acc["text"], s["stem"], F.lit(" "))).otherwise(acc["text"]).alias("text"), F.when(hit, F.array_append(acc["found"], s["label"])).otherwise(acc["found"]).alias("found"))

    return F.aggregate(stems, start, step, lambda acc: F.when(F.size(acc["found"]) == 1, acc["found"][0]))


def colour_class(category: Column | str, slug: Column | str) -> Column:
    """white, red, rose or orange from the category, else from the slug; NULL if neither names one."""
    n = normalize(category)
    s = normalize(F.replace(F.coalesce(column(slug), F.lit("")), F.lit("-"), F.lit(" ")))
    return (
        F.when(F.contains(n, F.lit("ОРАНЖ")), "orange").when(F.contains(n, F.lit("РОЗОВ")), "rose").when(F.contains(n, F.lit("КРАСН")), "red").when(F.contains(F.concat(F.lit(" "), n), F.lit(" БЕЛ")), "white")
        .when(s.rlike("ORANZHEVOE|ORANGE"), "orange").when(s.rlike("ROZOVOE|ROSE"), "rose").when(F.contains(s, F.lit("KRASNOE")), "red").when(F.contains(s, F.lit("BELOE")), "white")
    )


def is_generic(c: Column | str) -> Column:
    """A stop word, or four digits once О and I are read as 0 and 1."""
    c = column(c)
    return c.isin(W.NAME_STOP) | F.translate(c, "ОI", "01").rlike("^[0-9]{4}$")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""
    zeros = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    table = F.aggregate(
        F.sequence(F.lit(1), F.length(a)),
        zeros,
        lambda row, i: F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda acc, j: F.array_append(acc, F.when(F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1)), row[j - 1] + 1).otherwise(F.greatest(row[j], acc[j - 1]))),
        ),
    )
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(table[F.length(b)])


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Normalised insertion-deletion similarity, 2 * LCS / (|a| + |b|); 1 for two empty strings."""
    a, b = column(a), column(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)
