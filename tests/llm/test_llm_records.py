"""P2, P6, P7, P8, P9 against brute force and on edge cases."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cellarspark.llm import canonical, linkage, mixing, packing, quality, queries

NAMES = [(1, "Карминель чёрная"), (1, "Ночная ягода"), (2, "Карминель белая"), (3, "Пухлянка"), (4, "Первенец лимана")]


def distance(a: str, b: str) -> int:
    """Edits with swapped neighbours as one, by the full table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_brute_force() -> None:
    rng = random.Random(5)
    words = list({"".join(rng.choices("абв", k=rng.randrange(1, 7))) for _ in range(60)})
    trie = canonical.Trie(list(enumerate(words)))
    paths = {p: r for p, r in trie.exact.items()}
    for _ in range(60):
        w = "".join(rng.choices("абв", k=rng.randrange(1, 7)))
        for k in (0, 1, 2):
            want: dict[int, int] = {}
            for p, refs in paths.items():
                if (d := distance(w, p)) <= k:
                    for r in refs:
                        want[r] = min(d, want.get(r, d))
            assert trie.search(w, k) == want


@pytest.mark.parametrize(
    ("value", "ref"),
    [("пухлянка", 3), ("Pukhlyanka", 3), ("Пухляка", 3), ("Пулхянка 34 %", 3), ("сорт Пухлянка (клон 3)", 3), ("Белая карминель", 2), ("Ночная ягода", 1), ("Первенец лим.", 4), ("Пухлянка и дикая форма", 3), ("Карминель", 0), ("купаж", 0), ("Хохлач", 0), ("34 %", 0)],
)
def test_values_find_their_entry(value: str, ref: int) -> None:
    assert canonical.resolve(value, canonical.Trie(NAMES))[0] == ref


def test_mapping_rows(spark) -> None:
    lex = spark.createDataFrame([(1, "Пухлянка", "Пухлянка", "grape", False), (1, "Другая", "Пухлянка", "grape", True)], "ref_id long, lex_key string, canonical string, kind string, is_alias boolean")
    rows = [(1, "grape", "Пухлянка", 9), (2, "grape", "другая", 9), (3, "grape", None, 9), (4, "region", "Пухлянка", 9), (5, "grape", "", 9), (6, None, "x", 9), (2, "grape", "другая", 9)]
    df = spark.createDataFrame(rows, "row_id long, field string, value string, ref_id int")
    out = canonical.map_values(df, lex, ["row_id"], "field", "value").collect()
    assert sorted((r.row_id, r.ref_id, r.is_canonical) for r in out) == [(1, 1, True), (2, 1, False), (2, 1, False), (4, 0, False)]
    assert {r.ref_id for r in canonical.map_values(df, lex.limit(0), ["row_id"], "field", "value").collect()} == {0}


def test_fill_is_the_best_there_is() -> None:
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 60)
        counts: dict[int, int] = {}
        for i in items:
            counts[i] = counts.get(i, 0) + 1
        took = packing.best_fill(sorted(counts, reverse=True), counts, room)
        assert all(n <= counts[s] for s, n in took.items())
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room)
        assert sum(s * n for s, n in took.items()) == best


def test_containers(spark) -> None:
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 3, 50, 99, 100, 101, 250])) for i in range(300)] + [(1000, None), (1, 5)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0)], "capacity_id int, capacity_tokens long")
    out = packing.fill_containers(df, caps, "doc_id").collect()
    for cap, size in ((1, 100), (2, 64)):
        own = [r for r in out if r.capacity_id == cap]
        assert sum(r.tokens for r in own) == sum(s or 0 for _, s in sizes)
        load: dict[int, int] = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        assert max(load.values()) <= size
        assert len(own) == sum(max(1, -(-(s or 0) // size)) for _, s in sizes)
        assert all(r.n_pieces == 1 for r in own if r.tokens < size and r.piece_no == 1)
    assert {r.capacity_id for r in out} == {1, 2}
    assert packing.fill_containers(df.limit(0), caps, "doc_id").count() == 0


def test_flight_keeps_both_totals() -> None:
    rng = random.Random(1)
    size = [float(rng.randrange(1, 500)) for _ in range(400)]
    p = mixing.flight([0.37] * 400, size, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 0.37 * 400) < 1e-6
    assert abs(sum(a * b for a, b in zip(p, size)) - 0.37 * sum(size)) < 1e-3
    assert sum(mixing.land(mixing.flight([0.5] * 4, [7.0] * 4, rng), [7.0] * 4)) == 2


def test_flight_is_unbiased() -> None:
    mean = [0.0] * 6
    for s in range(4000):
        for k, x in enumerate(mixing.flight([0.5] * 6, [1.0, 2, 3, 4, 5, 6], random.Random(s))):
            mean[k] += x / 4000
    assert all(abs(m - 0.5) < 0.03 for m in mean)


def test_mix_reaches_its_shares(spark) -> None:
    rng = random.Random(4)
    rows = [(i, "big" if i % 10 else "small", rng.randrange(1, 400)) for i in range(4000)] + [(9001, None, 5), (9002, "other", 5), (9003, "big", 0), (9004, "big", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goal = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3)], "source string, target_share double, max_repeat int")
    drawn = mixing.draw(df, goal, "doc_id").cache()
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    for r in mixing.shares(drawn, goal).collect():
        assert abs(r.actual_share - r.target_share) < 0.003
        assert r.most_uses <= r.max_repeat
    assert mixing.draw(df.limit(0), goal, "doc_id").count() == 0
    assert mixing.draw(df, goal.limit(0), "doc_id").count() == 0


def test_too_many_capacities_and_sources_are_refused(spark) -> None:
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    many = spark.range(packing.MAX_CAPACITIES + 1).select(F.col("id").cast("int").alias("capacity_id"), (F.col("id") + 10).alias("capacity_tokens"))
    with pytest.raises(ValueError, match="capacities"):
        packing.fill_containers(sizes, many, "doc_id")
    assert packing.fill_containers(sizes, many.limit(packing.MAX_CAPACITIES), "doc_id").count() == packing.MAX_CAPACITIES
    goals = spark.range(mixing.MAX_SOURCES + 1).select(F.col("id").cast("string").alias("source"), F.lit(0.001).alias("target_share"), F.lit(1).alias("max_repeat"))
    texts = spark.createDataFrame([(1, "5", 5)], "doc_id long, source string, tokens long")
    with pytest.raises(ValueError, match="sources"):
        mixing.draw(texts, goals, "doc_id")


def test_a_window_holds_many_large_containers(spark) -> None:
    sizes = spark.createDataFrame([(i, 30_000 + i % 7 * 9_000) for i in range(300)], "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 400_000)], "capacity_id int, capacity_tokens long")
    boxes = packing.fill_containers(sizes, caps, "doc_id").groupBy("container_id").agg(F.sum("tokens").alias("t")).collect()
    assert sum(r.t for r in boxes) / (400_000 * len(boxes)) > 0.95


WORDS = [("ru", w) for w in "и в не на что он с по из это к но".split()] + [("en", w) for w in "the of and a to in is it".split()]
FORMS = [
    ("Вино выдержали в бочке, и оно не потеряло тон, но это не всё. На второй день он стал мягче.", "prose"),
    ("- Пухлянка\n- Рубелан\n- Совилан\n- Мерлузан", "list"),
    ("Вино;Год;Цена\nПухлянка;2012;100\nРубелан;2013;200\nСовилан;2014;300", "table"),
    ("Сорт          Год     Цена\nПухлянка      2012    100\nРубелан       2013    200", "table"),
    ("qwx zxcv bnml kjhg qwrt plkj mnbv zxcv", "junk"),
    ("88 77 66 55 44 33 22 11 99", "junk"),
    ('<div class="a"> <a class="b"> <span class="c"> <td class="d">', "junk"),
    ("дешёвое вино! " * 30, "junk"),
    ("— Вино выдержали в бочке, и оно не потеряло тон, но это не всё.\n— На второй день он стал мягче, и это не к худу.", "prose"),
    ("", ""),
    (" \n ", ""),
]


@pytest.mark.parametrize(("text", "form"), FORMS)
def test_forms(text: str, form: str) -> None:
    assert quality.form_of(text, frozenset(w for _, w in WORDS)) == form


def test_ranks_equal_brute_force(spark) -> None:
    rng = random.Random(6)
    rows = [(s, g, rng.choice([0, 0, 0, 1, 2, 3, 45])) for s in (0, 1) for g in ("ru", "en") for _ in range(200)]
    out = quality.exact_ranks(spark.createDataFrame(rows, "stat int, lang string, value int")).collect()
    for r in out:
        own = [v for s, g, v in rows if (s, g) == (r.stat, r.lang)]
        assert (r.below, r.upto, r.total) == (sum(v < r.value for v in own), sum(v <= r.value for v in own), len(own))
    assert len(out) == len({tuple(r) for r in rows})


def test_scores(spark) -> None:
    prose = FORMS[0][0]
    rows = [(i, f"{prose} {prose[:i]}", None if i % 3 else "ru", 1.0) for i in range(40)] + [(50, FORMS[2][0], "ru", 1.0), (51, None, "ru", 1.0), (52, "", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    common = spark.createDataFrame(WORDS, "lang string, word string")
    out = {r.id: r for r in quality.outlier_scores(docs, "doc_id", "text", "lang", common).collect()}
    assert set(out) == {*range(40), 50}
    assert max(out.values(), key=lambda r: r.score).id == 50
    assert quality.outlier_scores(docs.limit(0), "doc_id", "text", "lang", common).count() == 0
    assert quality.unlike_prose(docs.limit(0), "doc_id", "text", "lang", common).count() == 0


def test_scores_equal_brute_force(spark) -> None:
    rng = random.Random(4)
    words = [w for _, w in WORDS] + "вино лоза бочка тон year cellar 12 ; .".split()
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    common = spark.createDataFrame(WORDS, "lang string, word string")
    by = {g: frozenset(w for k, w in WORDS if k == g) for g in ("ru", "en")}
    steps = [quality.steps(quality.statistics(t, by, by["ru"] | by["en"], "ru")[1]) for t in texts]
    once = list(set(steps))
    for r in quality.outlier_scores(docs, "doc_id", "text", "lang", common).collect():
        logs = []
        for k, (side, _) in enumerate(quality.STATISTICS.values()):
            v = steps[r.id][k]
            le, ge = (sum(x[k] <= v for x in once) / len(once), sum(x[k] >= v for x in once) / len(once))
            logs.append(-math.log(ge if side > 0 else le if side < 0 else min(1.0, 2 * min(le, ge))))
        assert r.score == pytest.approx(sum(logs) / len(logs), abs=1e-6)


def _mixture(prose: int, lists: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = "вино бочка лоза тон вкус аромат почва ягода урожай погреб склон ряд год осень".split()
    small = [w for g, w in WORDS if g == "ru"]
    told = lambda: " ".join(x for _ in range(rng.randint(4, 8)) for x in (rng.choice(words), rng.choice(small))).capitalize() + "."
    out = [(k, " ".join(told() for _ in range(rng.randint(2, 6))), "ru") for k in range(prose)]
    return out + [(10_000 + k, "\n".join(f"- {rng.choice(words).capitalize()}" for _ in range(rng.randint(4, 12))), "ru") for k in range(lists)]


@pytest.mark.parametrize(("prose", "lists"), [(300, 20), (200, 100), (60, 240), (0, 50)])
def test_no_list_is_lost_however_many_there_are(spark, tmp_path, prose: int, lists: int) -> None:
    spark.createDataFrame(WORDS, "lang string, word string").write.parquet(str(tmp_path / "common_word.parquet"))
    spark.createDataFrame(_mixture(prose, lists), "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.doc_id, r.form) for r in queries.p9_found(spark, str(tmp_path)).collect()} == {(10_000 + k, "list") for k in range(lists)}


def test_the_gate_decides_about_most_prose(spark) -> None:
    docs = spark.createDataFrame(_mixture(300, 60), "doc_id long, text string, lang string")
    common = spark.createDataFrame(WORDS, "lang string, word string")
    by_lang = quality._frequent_words(common)
    fields = (docs, "doc_id", "text", "lang", by_lang)
    ranks = quality.fit_ranks(*fields)
    gates = quality.fit_gates(*fields, ranks)
    passed = [r.id for r in quality._judge(*fields, ranks, gates).where("form is not null").collect()]
    assert sum(i < 10_000 for i in passed) < 0.3 * 300 and sum(i >= 10_000 for i in passed) == 60


def test_copies_of_one_list_are_found(spark, tmp_path) -> None:
    """A list that nine of ten rows copy is still reported, and its copies do not lower its score."""
    prose, item = FORMS[0][0], FORMS[1][0]
    rows = [(i, f"{prose} {prose[:i]}", "ru") for i in range(10)] + [(100 + i, item, "ru") for i in range(90)]
    common = spark.createDataFrame(WORDS, "lang string, word string")
    common.write.parquet(str(tmp_path / "common_word.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.doc_id, r.form) for r in queries.p9_found(spark, str(tmp_path)).collect()} == {(100 + i, "list") for i in range(90)}
    score = lambda d: quality.outlier_scores(d, "doc_id", "text", "lang", common).where("id = 100").first().score
    assert score(docs) == pytest.approx(score(docs.where("doc_id <= 100")))


CARDS = [
    (0, "tikhiy-khutor-baloraben", "Тихий Хутор «Балорабен»", "Дом Мокшави", "Пухлянка", "", "Белое"),
    (1, "tikhiy-khutor-baloraben-krasnoe", "Балорабен Тихий Хутор Красное", "Дом Мокшави", "", "", "Красное"),
    (2, "lunnyy-mostik-silatadan", "Лунный Мостик Силатадан", "Шато Грайвенти", None, None, None),
    (3, "lunnyy-mostik-silatadan", "Лунный Мостик Силатадан", "Шато Грайвенти", None, None, None),
    (4, None, None, None, None, None, None),
]
PAGES = [
    (10, "Вино Тихий Хутор Балорабен белое 0.75 л", "", "", "", "", ""),
    (11, "Тихий Хутор Балорабне", "", "красное", "", "", ""),
    (12, "Wine Lunnyy Mostik Silatadan купить", "Грайвенти", "", "", "", ""),
    (13, "Вина Дом Мокшави — каталог и цены", "Дом Мокшави", "", "", "https://a.example/p/tikhiy-khutor-baloraben", ""),
    (14, "Тихий Хутор Балорабен розовое", "", "", "", "", ""),
    (15, "Тихий Хутор Зимидора белое", "", "", "", "", ""),
    (16, None, None, None, None, None, None),
    (12, "Wine Lunnyy Mostik Silatadan купить", "Грайвенти", "", "", "", ""),
]


CARD = "row_idx long, slug string, name string, winery string, grape string, color string, category string"
PAGE = "cache_id long, name string, winery string, color string, grape string, source string, text string"
MATCH = f"mutual and fits and confidence >= {linkage.CONFIDENT}"


def test_links(spark) -> None:
    cards = spark.createDataFrame(CARDS, CARD).withColumn("score", F.lit(1))
    pages = spark.createDataFrame(PAGES, PAGE).withColumn("page", F.lit("x"))
    out = linkage.link(pages, cards).where(MATCH).collect()
    assert sorted((r.cache_id, r.row_idx) for r in out) == [(10, 0), (11, 1), (12, 2), (12, 2)]
    assert all(0 < r.confidence < 1 for r in out)
    assert linkage.link(pages, cards.limit(0)).count() == 0
    assert linkage.link(pages.limit(0), cards).count() == 0


def test_links_do_not_depend_on_blocks(spark, monkeypatch) -> None:
    """The same pairs, scores and confidences whatever the blocks; a wrong Cyrillic letter finds its card."""
    cards = spark.createDataFrame(CARDS, CARD)
    pages = spark.createDataFrame([*PAGES, (20, "Тихий Хутор Балоражен белое", "", "", "", "", "")], PAGE)
    got = {}
    for record, page in ((50_000, 2_000), (1, 2), (2, 1)):
        monkeypatch.setattr(linkage, "RECORD_BLOCK", record)
        monkeypatch.setattr(linkage, "PAGE_BLOCK", page)
        got[record] = sorted((r.cache_id, r.row_idx, round(r.score, 9), round(r.gap, 9), round(r.cover, 9), round(r.told, 9), round(r.confidence, 6)) for r in linkage.link(pages, cards).collect())
    assert got[50_000] == got[1] == got[2]
    assert (20, 0) in {g[:2] for g in got[1] if g[-1] >= linkage.CONFIDENT}


def _best_two(block: dict, terms, dense: int) -> list[tuple]:  # noqa: ANN001
    before, linkage.DENSE = linkage.DENSE, dense
    try:
        return [(r, round(s, 4), round(c, 4), round(t, 4)) for r, s, c, t in linkage.Block(block).best_two(terms, 3)]
    finally:
        linkage.DENSE = before


def test_two_best_records_equal_brute_force() -> None:
    rng = random.Random(8)
    np = linkage.np
    for _ in range(30):
        records = {r: set(rng.sample(range(100, 140), rng.randint(1, 8))) for r in range(rng.randint(1, 25))}
        keys = np.array(sorted(set().union(*records.values())), dtype=np.int64)
        owners = [sorted(r for r, t in records.items() if k in t) for k in keys]
        weights, labelled = np.array([rng.random() for _ in keys]), np.array([rng.random() < 0.6 for _ in keys])
        block = {"record": np.array(sorted(records), dtype=np.int64), "keys": keys, "starts": np.cumsum([0, *map(len, owners)]), "rows": np.concatenate([np.array(o, dtype=np.int32) for o in owners]), "weights": weights, "labelled": labelled, "own": np.ones(len(records))}
        terms = np.array(sorted(rng.sample(range(95, 145), 12)), dtype=np.int64)
        rng.shuffle(terms)
        got = [x for dense in (1, 4, 1000) for x in [_best_two(block, terms, dense)]]
        assert got[0] == got[1] == got[2]
        got = got[0]
        w = {int(k): (x, bool(y)) for k, x, y in zip(keys, weights, labelled)}
        scores = {r: sum(w[t][0] for t in own & {int(x) for x in terms}) for r, own in records.items() if any(w[t][1] for t in own & {int(x) for x in terms})}
        want = sorted(scores.items(), key=lambda x: (-round(x[1], 4), x[0]))[:2]
        assert [(r, s) for r, s, *_ in got] == [(r, round(s, 4)) for r, s in want]


def test_all_card_terms_of_a_label_are_kept(spark) -> None:
    """The grape of any card of a label finds it, and long lines and late grapes are read."""
    rows = [(0, "tikhiy-khutor-baloraben", "Тихий Хутор Балорабен", "Дом Мокшави", "", "", ""), (1, "tikhiy-khutor-baloraben-2", "Тихий Хутор Балорабен", "Дом Мокшави", ", ".join(["Пухлянка"] * 9 + ["Рубелан"]), "", "")]
    cards = linkage.records(spark.createDataFrame(rows, CARD)).collect()
    assert linkage.term_key("g:rubelan") in {t for c in cards for t in c.terms} and len({(c.label, c.maker) for c in cards}) == 1
    title = "Тихий Хутор Балорабен"
    assert linkage.headings("x " * 500 + "\n" + title, linkage.boilerplate.triples(title)) == [title]
