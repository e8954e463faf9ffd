"""Label words, signals, decisions, lexicon, products and even joins on small fixtures."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from cellarspark.functions import labels as L
from cellarspark.functions import pages as P
from cellarspark.operators import decisions, lexicon, rerank, signals
from cellarspark.operators.joins import join_even
from cellarspark.operators.products import page_products, product

WORDS = [
    # word, is a grape, colour, sweetness
    ("КРАСНОЕ", False, "red", None), ("KPACHOE", False, "red", None), ("КРАСНОС", False, "red", None), ("КРАСНОСТОП", True, None, None), ("БЕЛЫИ", False, "white", None), ("ОРАНЖЕВОГО", False, "orange", None),
    ("ROSE", False, "rose", None), ("5PIOT", False, None, "brut"), ("БРЮТ", False, None, "brut"), ("ПОЛУСЛАДКАЯ", False, None, "semi_sweet"), ("СУХОИ", False, None, "dry"), ("PINOT", False, None, None), ("ВИНО", False, None, None),
]


def test_word_classes(spark) -> None:
    df = spark.createDataFrame([(w, g) for w, g, *_ in WORDS], "word string, known boolean")
    out = {r.word: (r.c, r.s) for r in df.select("word", L.colour_of_word(F.col("word"), F.col("known")).alias("c"), L.sweetness_of_word(F.col("word")).alias("s")).collect()}
    assert out == {w: (c, s) for w, _, c, s in WORDS}
    grapes = df.where("known").select(F.col("word").alias("grape"))
    joined = {r.word: (r.colour, r.sweet) for r in signals.class_words(df, grapes).collect()}
    assert joined == out


def test_readings(spark) -> None:
    words = ["AJA3AHCKAЯ", "2О21", "MOGZAURI", "ДОЛИНА", "ВСТРКЛ", "ШАТО", "", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", L.repair_reading(F.col("w")).alias("r"), L.readable(F.col("w")).alias("ok"), L.shown_word(F.col("w")).alias("shown")).collect()
    got = {r.w: (r.r, r.ok) for r in rows}
    assert got["AJA3AHCKAЯ"][0] == "АЛАЗАНСКАЯ" and got["2О21"][0] == "2О21"
    assert got["ДОЛИНА"][1] and got["MOGZAURI"][1] and not got["ВСТРКЛ"][1]
    pairs = spark.createDataFrame([(["ПИНО", "НУАР", "МЕРЛО"],), ([],), (["КАБЕРНЕ"],)], "g array<string>").select(L.shown_grapes(F.col("g")).alias("s")).collect()
    assert [r.s for r in pairs] == ["Пино нуар, Мерло", "", "Каберне"]


def test_pinot_is_recovered_beside_its_mark(spark) -> None:
    rows = [(["PINO", "HYAP"],), (["HYAP"],), (["ПО", "ЬАР"],), ([],)]
    out = spark.createDataFrame(rows, "t array<string>").select(L.recovered_noir(F.col("t")).alias("n")).collect()
    assert [r.n for r in out] == [["НУАР"], [], ["ПИНО", "НУАР"], []]


def _brute(r: dict) -> tuple[int, bool]:
    """The decision list once more, as plain conditions."""
    second, sv = r["second"], r["second_visual"]
    gap, vgap = (1.0 if second is None else r["top"] - second), (1.0 if sv is None else r["visual"] - sv)
    alone, weak = second is None or r["size"] <= 1, r["visual"] < 0.45 and (sv is None or sv < 0.45)
    ex, house, top, v, n = r["exclusive"], r["house"], r["top"], r["visual"], r["words"]
    rules = [
        (r["method"] in ("barcode", "qr", "code"), True), (r["conflicts"], False), (r["generic"], not ex and not weak and v >= 0.75 and vgap >= 0.20), (ex and alone and not house and (top >= 0.55 or v >= 0.65), True),
        (ex and not house and top >= 0.58 and gap >= 0.08, True), (house and vgap < 0.03, False), (ex and not house and top >= 0.90 and vgap > 0 and v >= 0.50, True), (not ex and r["size"] == 1 and not house and v >= 0.65 and vgap >= 0.02, True),
        (not house and top < 0.25 and v >= 0.75 and vgap >= 0.20, True), (house and v >= 0.78 and vgap >= 0.06, True), (n == 0, not weak and v >= 0.70 and vgap >= 0.04), (ex and not house and top >= 0.58 and -0.02 <= vgap < 0, True),
        (vgap < -0.02, False), (vgap < 0 and n <= 0, False), (vgap == 0 and gap < 0.08, False), (ex and top >= 0.58 and gap >= 0.08, True), (top >= 0.75 and gap >= 0.20, True),
    ]
    return next(((k, bool(x)) for k, (fits, x) in enumerate(rules, 1) if fits), (18, False))


def test_decision_list_equals_brute_force_and_every_rule_is_hit(spark) -> None:
    grid = itertools.product(["ocr"], [0.2, 0.6, 0.95], [None, 0.1, 0.56, 0.94], [0.4, 0.66, 0.8], [None, 0.3, 0.55, 0.67, 0.8, 0.81], [True, False], [1, 3], [-1, 0, 2], [True, False], [True, False])
    names = ("method", "top", "second", "visual", "second_visual", "exclusive", "size", "words", "house", "generic")
    rows = [dict(zip(names, g), conflicts=False, id=k) for k, g in enumerate(grid)]
    rows += [dict(rows[0], method="qr", id=-1), dict(rows[0], conflicts=True, id=-2)]
    df = spark.createDataFrame(rows, "id int, method string, top double, second double, visual double, second_visual double, exclusive boolean, size int, words int, house boolean, generic boolean, conflicts boolean")
    got = {r.id: (r.rule, r.accepted) for r in decisions.with_leads(df).select("id", decisions.rule().alias("rule"), decisions.accepted().alias("accepted")).collect()}
    assert got == {r["id"]: _brute(r) for r in rows}
    # a NULL runner-up leads by 1, so a negative lead with words <= 0 (rule 14) needs words = -1
    assert {k for k, _ in got.values()} >= set(range(1, 19)) - {16}


def test_lexicon_cascade(spark) -> None:
    tokens = [("ШАРДОНЕ", "grape"), ("МУСКАТ", "grape"), ("СИРА", "grape"), ("АРАТТИ", "winery"), ("ЗОЛОТО", "name"), ("ALVEUS", "name"), ("БЕЛЕНЬКОЕ", "name"), ("ЗОЛОТО", "region"), ("ВИНО", "name")]
    lex = lexicon.build_lexicon(spark.createDataFrame(tokens, "token string, kind string"))
    by_key = {r.key: (r.canonical, r.kind, r.alias) for r in lex.collect()}
    assert by_key["ЗОЛОТО"] == ("ЗОЛОТО", "name", False) and by_key["CHARDONNAY"] == ("ШАРДОНЕ", "grape", True) and "ВИНО" not in by_key
    words = ["ШАРДОНЕ", "CHARDONNAY", "NLVEUS", "MUSCAI", "АРАГТИ", "ЗОNОТО", "СИР", "HYAP", "5PIOT", "ЩЩЩЩЩЩ", "", None]
    hits = {r.word: (r.catalog, r.kind, round(r.score, 2)) for r in lexicon.match_words(spark.createDataFrame([(w,) for w in words], "word string"), lex).collect()}
    assert hits["ШАРДОНЕ"] == ("ШАРДОНЕ", "grape", 1.0) and hits["CHARDONNAY"] == ("ШАРДОНЕ", "grape", 0.99) and hits["NLVEUS"] == ("ALVEUS", "name", 0.83)
    assert hits["MUSCAI"][:2] == ("МУСКАТ", "grape") and hits["АРАГТИ"] == ("АРАТТИ", "winery", 0.88) and hits["ЗОNОТО"] == ("ЗОЛОТО", "name", 0.9) and hits["СИР"] == ("СИРА", "grape", 0.99)
    assert set(hits) == {"ШАРДОНЕ", "CHARDONNAY", "NLVEUS", "MUSCAI", "АРАГТИ", "ЗОNОТО", "СИР"}
    text = spark.createDataFrame([(1, 0, "ЗОЛОТО"), (1, 1, "MOGZAURI"), (1, 2, "ЗОNОТО"), (2, 0, "ЩЩЩЩЩЩ")], "id int, pos int, word string")
    out = {r.id: (r.cleaned, r.n_kept, r.dropped, r.readable) for r in lexicon.clean_texts(text, "id", lexicon.match_words(text, lex)).collect()}
    assert out == {1: ("ЗОЛОТО", 1, 1, "MOGZAURI"), 2: ("", 0, 1, "")}
    assert lexicon.match_words(text.limit(0), lex).count() == 0


def test_ranking_by_attributes_is_diverse(spark) -> None:
    schema = "{k} {t}, colour string, sweetness string, grapes array<string>, tastes array<string>, brands array<string>, regions array<string>"
    profile = spark.createDataFrame([(1, "white", "dry", ["A", "B"], [], ["HOUSE"], []), (2, None, None, [], [], [], [])], schema.format(k="id", t="int"))
    cards = spark.createDataFrame([(0, "red", None, ["A", "B"], [], [], []), (1, "red", None, ["A"], [], [], []), (2, "red", None, ["A"], [], [], []), (3, "white", None, [], [], [], []), (4, None, None, [], [], ["HOUSE"], []), (5, "rose", None, [], [], [], [])], schema.format(k="row", t="int"))
    out = signals.rank_by_attributes(profile, cards, "id", "row").orderBy("place").collect()
    assert [(r.id, r.row, r.place) for r in out] == [(1, 0, 1), (1, 3, 2), (1, 4, 3), (1, 1, 4)]
    assert signals.rank_by_attributes(profile, cards.limit(0), "id", "row").count() == 0


PAGE = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage", "main": {"@type": ["Thing", "Product"], "name": " A  b ", "brand": {"name": "X"}, "gtin13": "46-1"}}]}</script>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE, {"name": "A b", "brand": "X", "winery": "X", "gtin": "461", "description": ""}),
        ("<script type='application/ld+json'>{broken</script>" + PAGE, {"name": "A b", "brand": "X", "winery": "X", "gtin": "461", "description": ""}),
        ("<p>nothing</p>", None),
        ('<script type="application/ld+json">[]</script>', None),
    ],
)
def test_products_of_pages(page: str, want: dict | None) -> None:
    assert product(page) == want


def test_page_products_and_links(spark) -> None:
    deep = '<script type="application/ld+json">' + '{"a":[' * 3000 + '{"@type":"product","name":"x"}' + "]}" * 3000 + "</script>"
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, deep)], "id int, html string")
    assert {r.id for r in page_products(df, "id", "html").collect()} >= {1}
    page = '<a class="result__a" href="//search.example/l/?uddg=https%3A%2F%2Fa.example%2Fx&amp;r=1"><b>T</b></a><a href="https://search.example/z" class="q result__a">own</a><a href="https://b.example">no</a>'
    links = spark.createDataFrame([(page,)], "html string").select(F.transform(P.anchors("html", "result__a"), lambda a: P.target_url(a["href"], "search.example", "/l/", "uddg")).alias("u")).first().u
    assert links == ["https://a.example/x", ""]


def test_even_join_equals_join(spark) -> None:
    df = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    unique = spark.createDataFrame([("hot", 1), ("k3", 2), ("z", 3)], "k string, w int")
    for how in ("inner", "left"):
        got, want = join_even(df, unique, "k", how), df.join(unique, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert join_even(df.limit(0), unique, "k").count() == 0


def test_logistic_head_learns(spark) -> None:
    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(400)] + [(None, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y int").select("a", "b", *[F.lit(0.0).alias(c) for c in "cdef"], "y")
    head = rerank.fit_logistic(df, list("abcdef"), "y", rounds=40)
    assert len(head) == rerank.PACKED
    good = df.where("y is not null").select((rerank.logistic([F.col(c) for c in "abcdef"], head) >= 0.5).cast("int").alias("p"), "y").where("p = y").count()
    assert good >= 380
    assert rerank.fit_logistic(df.where("y = 1"), list("abcdef"), "y")[:7] == [0.0] * 7


def test_boxes(spark) -> None:
    from cellarspark.operators import boxes as B

    sets = [(1, [(0, 0, 10, 10), (1, 1, 11, 11), (50, 50, 60, 60)]), (2, []), (3, None), (4, [(0, 0, 40, 40), (2, 0, 44, 40), (4, 0, 48, 40), (90, 0, 95, 90)])]
    df = spark.createDataFrame(sets, "id int, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    out = {r.id: [tuple(b) for b in r.boxes] for r in B.merge_overlaps(df, "id", "boxes").collect()}
    assert out == {1: [(0, 0, 11, 11), (50, 50, 60, 60)], 2: [], 3: [], 4: [(0, 0, 48, 40), (90, 0, 95, 90)]}
    b = df.select("id", F.size(B.drop_parts(F.col("boxes"), 100)).alias("n"), B.choose(F.col("boxes"), 100, 100).alias("c"), B.union(F.col("boxes")).alias("u")).collect()
    got = {r.id: (r.n, r.c and tuple(r.c), r.u and tuple(r.u)) for r in b}
    assert got[4][0] == 3 and got[4][2] == (0, 0, 95, 90) and got[1][1] == (50, 50, 60, 60) and got[2][1:] == (None, None)
    assert B.centre(100, 100) == (0, 14, 100, 86)


def test_vectors_through_a_head(spark) -> None:
    from cellarspark.operators import vectors

    df = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<float>")
    out = {r.id: r.vec for r in vectors.project(df, "id", "v", [[1.0, 1.0], [0.0, 1.0]]).collect()}
    assert out[1] == pytest.approx([0.5**0.5] * 2) and out[2] == [0.0, 0.0] and set(out) == {1, 2}
    with pytest.raises(Exception, match="numbers"):
        vectors.project(df, "id", "v", [[1.0]]).collect()
