"""What the reviews of the rounds found."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellarspark.llm import linkage, quality
from cellarspark.operators import fuzzy, index, signals
from cellarspark.plans import lexicon_queries, registry


def test_pairs_of_a_group_are_those_of_brute_force(spark, monkeypatch) -> None:
    monkeypatch.setattr(fuzzy, "ENTRY_BLOCK", 7)
    monkeypatch.setattr(fuzzy, "WORD_STEP", 5)
    r = random.Random(4)
    word = lambda: "".join(r.choices("АБВГД", k=r.choice((1, 4, 5, 6, 7, 31, 32, 33, 63, 64, 70))))
    words = [(r.choice("xyz"), word()) for _ in range(150)] + [("x", None), (None, "АБВГ"), ("y", ""), ("x", "БАБА"), ("x", "БАБА")]
    entries = [(r.choice("xyw"), word()) for _ in range(150)] + [("x", None), (None, "АБВГ"), ("y", "")]
    want = {(g, w, e, fuzzy.indel(w, e)) for g, w in words for h, e in entries if g and g == h and w and e and abs(len(w) - len(e)) <= 2 and fuzzy.indel(w, e) >= 0.7}
    got = fuzzy.near_pairs_within(spark.createDataFrame(words, "g string, word string"), spark.createDataFrame(entries, "g string, entry string"), "g", "word", "entry", 0.7).collect()
    assert len(got) == len(want) >= 20
    assert {tuple(x) for x in got} == want


def test_far_words_are_left_out_before_the_shuffle_of_pairs(spark) -> None:
    words = spark.createDataFrame([("АБВГДЕЖЗ",), ("АБВГДЕ",)], "word string")
    pairs = fuzzy.near_pairs(words, spark.createDataFrame([("АБВГДЕЗЖ",), ("ЖЗИКЛМАБ",)], "entry string"), "word", "entry", 0.8)
    assert {tuple(r) for r in pairs.collect()} == {("АБВГДЕЖЗ", "АБВГДЕЗЖ", 0.875), ("АБВГДЕ", "АБВГДЕЗЖ", 12 / 14)}
    assert "levenshtein" in pairs._jdf.queryExecution().executedPlan().toString()


def test_gates_come_from_all_texts(spark, monkeypatch) -> None:
    monkeypatch.setattr(quality, "SAMPLE", 5, raising=False)
    r = random.Random(9)
    small, words = "и в на с по из".split(), "вино бочка лоза тон вкус аромат почва ягода".split()
    told = lambda: " ".join(x for _ in range(6) for x in (r.choice(words), r.choice(small))).capitalize() + "."
    rows = [(k, " ".join(told() for _ in range(3)), "ru") for k in range(150)] + [(1_000 + k, "\n".join(f"- {r.choice(words)} {k}" for _ in range(5 + k % 7)), "ru") for k in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    by_lang = {"ru": set(small)}
    fields = (docs, "id", "text", "lang", by_lang)
    ranks = quality.fit_ranks(*fields)
    scores = [x.score for x in quality._judge(*fields, ranks, {}).where("form in ('list', 'table', 'junk')").collect()]
    assert len(scores) >= 60 and quality.fit_gates(*fields, ranks) == {"ru": pytest.approx(quality.MARGIN * min(scores))}


def test_words_of_one_card_are_found_together(spark) -> None:
    r = random.Random(2)
    cards = {k: set(r.sample("abcdefgh", 4)) for k in range(12)}
    sets = sorted({tuple(sorted(r.sample("abcdefghz", r.choice((1, 2, 3))))) for _ in range(60)})
    owners = spark.createDataFrame([(t, str(k)) for k, own in cards.items() for t in own], "token string, slug string")
    got = lexicon_queries._together(spark.createDataFrame([(list(x), list(x)) for x in sets], "words array<string>, all array<string>"), owners).collect()
    want = {x for x in sets if any(set(x) <= own for own in cards.values())}
    assert {tuple(x.words) for x in got} == want and len(got) == len(want) < len(sets)


def test_heaviest_owners_are_those_of_brute_force() -> None:
    r = random.Random(6)
    for _ in range(300):
        n, k = r.randint(1, 12), r.randint(0, 7)
        owners = [(r.randint(1, 4), r.getrandbits(n) & r.getrandbits(n)) for _ in range(k)]
        rest = r.getrandbits(n)
        weigh = {i: 5 + sum(w for w, x in owners if x >> i & 1) for i in range(n) if rest >> i & 1}
        assert linkage.best_owners(owners, rest, 5) == [(w, i) for i, w in sorted(weigh.items(), key=lambda x: (-x[1], x[0]))[:2]]


@pytest.mark.parametrize("frequent", [0, 3, 10**9])
def test_pages_find_their_two_best_records_without_meeting_all(spark, monkeypatch, frequent: int) -> None:
    """Score and gap are those of brute force wherever words begin to be frequent, and no page meets a record it shares nothing with."""
    monkeypatch.setattr(linkage, "FREQUENT", frequent)
    monkeypatch.setattr(linkage, "RECORD_BLOCK", 9)
    r = random.Random(3)
    lines, makers, grapes = "Тихий Северный Лунный Хутор Родник Курган".split(), ["Дом Мокшави", "Лоза Паринта", ""], "Пухлянка Рубелан Кубарис".split()
    proper = lambda: "".join(r.choice(("ба", "ло", "ра", "мен", "ти")) for _ in range(4)).capitalize()
    cards, pages = [], []
    for k in range(60):
        name = " ".join([*r.sample(lines, 2), proper()])
        cards.append((k, linkage.romanise(name).replace(" ", "-"), name, r.choice(makers), ", ".join(r.sample(grapes, r.randint(0, 2))), "", ""))
        pages.append((k, " ".join(r.sample(lines, r.randint(0, 3)) + r.choice(([], [proper()], [name]))), r.choice(makers), "", ", ".join(r.sample(grapes, r.randint(0, 2))), "", ""))
    catalog = spark.createDataFrame(cards, "row_idx long, slug string, name string, winery string, grape string, color string, category string")
    asked = spark.createDataFrame(pages, "cache_id long, name string, winery string, color string, grape string, source string, text string")
    own: dict = {}
    for c in linkage.records(catalog).collect():
        own.setdefault((c.label, c.maker), set()).update(zip(c.terms, c.kinds))
    df = {t: sum(t in x for x in own.values()) for t in set().union(*own.values())}
    weigh = lambda t: int(linkage.weight(linkage.np.array([df[t]]), len(own), t[1] in "dc")[0])
    want = {}
    for k, name, winery, color, grape, source, text in pages:
        keys = set(linkage.page_terms(name, winery, color, grape, source, text)[0])
        met = [[t for t in x if t[0] in keys] for x in own.values()]
        scores = sorted((sum(map(weigh, x)) for x in met if any(t[1] in "ldc" for t in x)), reverse=True)
        if scores:
            want[k] = (round(scores[0] * linkage.UNIT, 6), round((scores[0] - ([*scores, 0][1])) / scores[0], 6))
    got = {x.cache_id: (round(x.score, 6), round(x.gap, 6)) for x in linkage.link(asked, catalog).collect()}
    assert got == want and 40 < len(want) < 60


def test_profiles_meet_cards_in_blocks_and_keep_a_few(spark, monkeypatch) -> None:
    """The same order as by brute force over all pairs, of which only a few a profile and block go on."""
    monkeypatch.setattr(signals, "CARD_BLOCK", 40)
    monkeypatch.setattr(signals, "PROFILE_BLOCK", 7)
    r = random.Random(12)
    some = lambda x, n: r.sample(x, r.randint(0, n))
    rows = [(k, r.choice(("red", "white", None)), r.choice(("dry", None)), some("abcd", 2), some("xyz", 2), some(["P", "Q", "R"], 2), some(["N", "S"], 1)) for k in range(150)]
    shape = "{} long, colour string, sweetness string, grapes array<string>, tastes array<string>, brands array<string>, regions array<string>"
    profiles, cards = rows[:30], [(1_000 + k, *x) for k, *x in rows[20:]]
    kinds, want = list(signals.KINDS), set()
    for p in profiles:
        order = []
        for c in cards:
            both = [len(set(a) & set(b)) for a, b in zip(p[3:], c[3:])]
            counts = (both[0], int(p[1] == c[1] is not None), int(p[2] == c[2] is not None), min(1, both[2]), both[1], both[3])
            if any(counts):
                order.append((*(-x for x in counts), c[0]))
        order.sort()
        first = [next((o for o in order if o[kinds.index(k)] < 0), None) for k in ("colour", "brand", "grape")]
        picked = [o for o in dict.fromkeys([*order[:1], *first, *order]) if o][:4]
        want |= {(p[0], o[-1], n + 1, *(-x for x in o[:-1])) for n, o in enumerate(picked)}
    asked, own = spark.createDataFrame(profiles, shape.format("id")), spark.createDataFrame(cards, shape.format("row"))
    assert {tuple(x) for x in signals.rank_by_attributes(asked, own, "id", "row").collect()} == want and len(want) > 100
    assert signals.nearest_by_attributes(asked, own, "id", "row", 4).count() <= 30 * 4 * 7


def test_compatible_words_are_of_every_row(spark, tmp_path) -> None:
    """Any cache_id counts, repeated or missing, and the rows are those of the SQL."""
    cards = [(0, "a", "Тихий Хутор", "Мокшави", "Рубелан"), (1, "b", "Лунный Хутор", "Паринта", None), (2, "c", "Лунный Курган", "Мокшави", "Кубарис")]
    asked = [
        (1, "вино тихий хутор", "Мокшави Кубарис белое"),  # a card has all: its words only
        (2, "лунный рубелан", "Курган Тихий Паринта Кубарис"),  # none has all: the words of any
        (2, "лунный", "Рубелан Мокшави"),
        (3, "вино белое", "Хутор неведомый белое"),  # no owned word: all fit
        (20, "хутор", "Тихий Курган"),
        (41, None, "Хутор"),
        (42, "хутор", None),
        (None, "хутор", "Хутор Курган"),
    ]
    r = random.Random(5)
    words = "тихий лунный хутор курган мокшави паринта рубелан кубарис белое".split()
    some = lambda n: " ".join(r.sample(words, r.randint(0, n)))
    asked += [(100 + k, some(4), some(5)) for k in range(80)]
    pq.write_table(pa.table(dict(zip(("row_idx", "slug", "name", "winery", "grape"), zip(*cards)))), tmp_path / "strapi_output0709.parquet")
    pq.write_table(pa.table(dict(zip(("cache_id", "query", "name"), zip(*asked)))), tmp_path / "external_cache.parquet")
    got = [tuple(x) for x in lexicon_queries.compatible_words(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("strapi_output0709", "external_cache"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert len(got) == len(set(got)) and set(got) == set(con.execute(registry.SQL["compatible_words"]).fetchall())
    assert {x for x in got if x[0] == 1} == {(1, "МОКШАВИ")} and {x for x in got if x[0] == 20} == {(20, "ТИХИЙ")}
    assert {x[0] for x in got} >= {None, 1, 2, 3, 20, 41} and len({x[0] for x in got if (x[0] or 0) >= 100}) > 40


@pytest.mark.parametrize("block", [1, 2, 1_000])
def test_sets_meet_cards_in_blocks(monkeypatch, block: int) -> None:
    monkeypatch.setattr(index, "CARD_BLOCK", block)
    r = random.Random(8)
    cards = [sorted(r.sample(range(9), r.randint(1, 5))) for _ in range(15)]
    sets = [list(x) for x in {tuple(sorted(r.sample(range(11), r.randint(1, 4)))) for _ in range(90)}]
    rows = [(min(x), x, x) for x in sets] + [(x, None, c[i + 1 :]) for c in cards for i, x in enumerate(c)]
    rows.sort(key=lambda x: (x[0], x[1] is None))
    shape = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 7]), shape)], names=["token", "words", "all"]) for i in range(0, len(rows), 7)]
    got = [tuple(x) for b in index.sets_on_cards(iter(batches)) for x in b.column(0).to_pylist()]
    want = {tuple(x) for x in sets if any(set(x) <= set(c) for c in cards)}
    assert len(got) == len(set(got)) and set(got) == want and 10 < len(want) < len(sets)
