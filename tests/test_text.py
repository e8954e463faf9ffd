"""Text functions on fixed cases and against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.operators.fuzzy import indel


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c").alias("r")).first().r


def test_normalize(spark) -> None:
    assert one(spark, " Ёлка-0, 1x ", T.normalize) == "ЕЛКА О IX"
    assert one(spark, None, T.normalize) == ""
    assert one(spark, "", T.normalize) == ""


def test_tokens(spark) -> None:
    assert one(spark, "т а б и я вино", T.tokens) == ["ТАБИЯ", "ВИНО"]
    assert one(spark, "т а вн б и вино", T.tokens) == ["ВИНО"]
    assert one(spark, "3олото", T.tokens) == ["ЗОЛОТО"]
    assert one(spark, "AлиготE", T.tokens) == ["АЛИГОТЕ"]
    assert one(spark, None, T.tokens) == []


def test_years_and_cuts(spark) -> None:
    assert one(spark, "урожай 2О15, 1999 и 2015", T.years) == ["2015", "1999"]
    assert one(spark, "aaa bbb, ccc", lambda c: T.short_text(c, 9)) == "aaa bbb…"
    assert one(spark, "aaa", lambda c: T.short_text(c, 9)) == "aaa"
    assert one(spark, "card-12", T.copy_stem) == "card"


def test_classes(spark) -> None:
    assert one(spark, "полусухое вино", T.sweetness) == "semi_dry"
    assert one(spark, "сухое и сладкое", T.sweetness) is None
    assert one(spark, "Белое", lambda c: T.colour_class(c, F.lit(""))) == "white"
    assert one(spark, None, lambda c: T.colour_class(c, F.lit("x-krasnoe"))) == "red"


def test_indel_matches_python(spark) -> None:
    rng = random.Random(1)
    pairs = [("".join(rng.choices("абвг", k=rng.randrange(6))), "".join(rng.choices("абвг", k=rng.randrange(6)))) for _ in range(60)]

    def slow(a: str, b: str) -> float:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return 1.0 if not a and not b else 2 * row[-1] / (len(a) + len(b))

    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio("a", "b").alias("r"))
    for r in df.collect():
        assert abs(r.r - slow(r.a, r.b)) < 1e-12 and abs(indel(r.a, r.b) - slow(r.a, r.b)) < 1e-12
