"""Index, dictionary, vector, cache and streaming operators on small fixtures and brute force."""

from __future__ import annotations

import random

import pytest

import numpy as np
from pyspark.sql import functions as F

from cellarspark.functions import pages
from cellarspark.operators import fuzzy, index, lookup_cache, vectors
from cellarspark.plans.lineage import cut
from cellarspark.sources.tables import cell
from cellarspark.streaming import lookups


def test_first_rows(spark) -> None:
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", None), (3, None, "y"), (4, "nan", "z"), (5, "", "q")], "row_idx long, slug string, name string")
    assert [tuple(r) for r in index.first_rows(df, "slug", "row_idx").collect()] == [("a", 1, None)]


def test_cells(spark) -> None:
    df = spark.createDataFrame([(None,), ("NaN",), (" a ",), ("",)], "c string")
    assert [r.c for r in df.select(cell("c").alias("c")).collect()] == ["", "", "a", ""]


def test_greedy_intersection_skips_emptying_terms(spark) -> None:
    df = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("z", "c")], "slug string, token string")
    assert [r.slug for r in index.greedy_intersection(df, "slug", ["a", "c", "b"]).collect()] == ["x"]
    assert index.greedy_intersection(df, "slug", ["none"]).count() == 0


def test_margin_rejects_near_ties(spark) -> None:
    words = spark.createDataFrame([("аликот",), ("шарданэ",), (None,), ("",)], "word string")
    names = spark.createDataFrame([("алигот",), ("аливот",), ("шардоне",), (None,)], "entry string")
    out = fuzzy.margin_match(words, names, "word", "entry", 0.7, 0.04)
    assert [(r.word, r.entry) for r in out.collect()] == [("шарданэ", "шардоне")]
    assert fuzzy.margin_match(words, names.limit(0), "word", "entry", 0.7, 0.04).count() == 0


def test_margin_against_brute_force(spark) -> None:
    words = ["кабренель", "кабрнель", "мерлузан", "мерлузам", "пьерлан", "пьерлин", "сольмера"]
    names = ["кабренель", "мерлузан", "пьерлан", "сольмера", "совилан"]
    want = set()
    for w in words:
        s = sorted((-fuzzy.indel(w, n), n) for n in names if abs(len(n) - len(w)) <= 2)
        if s and -s[0][0] >= 0.8 and (len(s) < 2 or -s[1][0] < 0.8 or s[1][0] - s[0][0] >= 0.05):
            want.add((w, s[0][1]))
    out = fuzzy.margin_match(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(n,) for n in names], "n string"), "w", "n", 0.8, 0.05)
    assert {(r.w, r.n) for r in out.collect()} == want


def test_nearest_is_exact(spark) -> None:
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 8))
    m[5] = m[6]
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(200, None), (201, [])], "id long, v array<float>")
    got = vectors.nearest(df.where("id % 20 = 0"), df, "id", "v", 5, block=16).collect()
    f = m.astype(np.float32).astype(np.float64)
    norm = np.linalg.norm(f, axis=1, keepdims=True)
    u = np.divide(f, norm, out=np.zeros_like(f), where=norm > 0)
    for q in range(0, 90, 20):
        s = np.round(u @ u[q], 6)
        want = sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)] == want
    assert vectors.nearest(df.limit(0), df, "id", "v", 5).count() == 0


def test_cache_rules(spark) -> None:
    now = 1_000_000.0
    rows = [("found", None, 0.0), ("empty", None, now - lookup_cache.NEGATIVE_TTL), ("empty", None, now - lookup_cache.NEGATIVE_TTL - 1), ("empty", 10, now - 5), ("not_found", 10, now - 11), ("empty", 10, 0.0), ("error", None, now), ("non_html", None, None), (None, None, now)]
    df = spark.createDataFrame(rows, "status string, negative_ttl int, cached_at double")
    assert [r.u for r in df.select(lookup_cache.usable(now).alias("u")).collect()] == [True, True, False, True, False, False, False, False, False]


def test_cache_upsert_and_fill(spark) -> None:
    old = spark.createDataFrame([("k", 1.0, 1, "a", ""), ("l", None, 2, "", "b")], "k string, at double, id long, x string, y string")
    new = spark.createDataFrame([("k", 2.0, 3, "", "c")], "k string, at double, id long, x string, y string")
    assert {(r.k, r.id) for r in lookup_cache.upsert(old, new, "k", "at", "id").collect()} == {("k", 3), ("l", 2)}
    filled = lookup_cache.first_filled(old.unionByName(new).fillna(0.0, ["at"]), "k", ["at", "id"], ["x", "y"])
    assert {tuple(r) for r in filled.collect()} == {("k", "a", "c"), ("l", "", "b")}


def test_pages(spark) -> None:
    html = '<html><head><TITLE>A &amp; B</TITLE><meta name="description" content="d &lt;x"></head><body><script>no()</script><p>one<b>two</b></p><a href="/u">l</a><a href="">m</a></body></html>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = df.select(pages.title("html"), pages.meta("html", "description"), pages.visible_text("html"), pages.links("html")).collect()
    assert tuple(got[0]) == ("A & B", "d <x", "A & B one two l m", ["/u"])
    assert tuple(got[1]) == ("", "", "", [])


def test_stream_lets_each_event_through_once(spark, tmp_path) -> None:
    rows = [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-02 10:00:00", "b")]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted((r.event_type, r.n) for r in lookups.event_counts(spark, str(tmp_path)).collect()) == [("a", 1), ("b", 1)]


def test_cut_keeps_rows(spark) -> None:
    assert sorted(r.id for r in cut(spark.range(5)).collect()) == list(range(5))


@pytest.mark.parametrize(("least", "window"), [(0.84, 2), (0.80, 2), (0.75, 1)])
def test_near_pairs_lose_none(spark, least: float, window: int) -> None:
    rng = random.Random(11)
    names = ["".join(rng.choices("АБВГД", k=rng.randint(1, 14))) for _ in range(120)]
    words = [*names[:20], *("".join(c for c in n if rng.random() > 0.1) + rng.choice(["", "А", "Б"]) for n in names)]
    out = fuzzy.near_pairs(spark.createDataFrame([(w,) for w in [*words, "", None]], "w string"), spark.createDataFrame([(n,) for n in [*names, None]], "n string"), "w", "n", least, window)
    want = {(w, n) for w in words for n in names if w and n and abs(len(w) - len(n)) <= window and fuzzy.indel(w, n) >= least}
    assert {(r.w, r.n) for r in out.collect()} == want and out.count() == len(want)


def test_unique_joins_equal_brute_force(spark) -> None:
    rng = random.Random(12)
    names = sorted({"".join(rng.choices("АБВ", k=rng.randint(3, 8))) for _ in range(60)})
    target = {n: f"T{i % 25}" for i, n in enumerate(names)}
    words = [*names[:10], *(n[: rng.randint(2, 8)] for n in names), *(n[rng.randint(0, 2) :] for n in names), *(n[:1] + "N" + n[2:] for n in names)]
    w = spark.createDataFrame([(x,) for x in [*words, "", None]], "w string")
    d = spark.createDataFrame([(n, target[n]) for n in names] + [(None, "x"), ("", "y")], "n string, t string")

    def brute(fits):  # noqa: ANN001, ANN202
        out = {x: {target[n] for n in names if fits(x, n)} for x in words if x}
        return {(x, min(t)) for x, t in out.items() if len(t) == 1}

    def edits(a: str, b: str) -> bool:
        return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or any(a == b[:i] + b[i + 1 :] for i in range(len(b))) or any(b == a[:i] + a[i + 1 :] for i in range(len(a))))

    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(fuzzy.unique_affix(w, d, "w", "n", "t", 3, 2)) == brute(lambda x, n: len(x) >= 3 and n.startswith(x) and len(n) - len(x) <= 2)
    assert got(fuzzy.unique_affix(w, d, "w", "n", "t", 3, 2, suffix=True)) == brute(lambda x, n: len(x) >= 3 and n.endswith(x) and len(n) - len(x) <= 2)
    assert got(fuzzy.unique_one_edit(w, d, "w", "n", "t", 4)) == brute(lambda x, n: len(x) >= 4 and edits(x, n))
    assert got(fuzzy.unique_wildcard(w, d, "w", "n", "t", "[A-Z]", 4)) == brute(lambda x, n: len(x) >= 4 and x.count("N") == 1 and len(x) == len(n) and all(a == b or a == "N" for a, b in zip(x, n)))
    assert fuzzy.unique_affix(w, d.limit(0), "w", "n", "t", 3, 2).count() == 0
