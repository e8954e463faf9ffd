"""Fusion, scaling, evaluation, near-equal vectors, and the file sources."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cellarspark.operators import rerank
from cellarspark.sources import files


def test_logistic(spark) -> None:
    packed = [1.0, 0, 0, 0, 0, 0, 0.5, 2.0, 0, 0, 0, 0, 0, 0.0, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(3.0,), (None,)], "x double")
    got = [r.s for r in df.select(rerank.logistic([F.col("x")] * 6, packed).alias("s")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-1.5)), 1 / (1 + math.exp(1.5))])
    with pytest.raises(ValueError, match="19"):
        rerank.logistic([F.col("x")] * 6, packed[:-1])


def test_scores(spark) -> None:
    df = spark.createDataFrame([([0.2, 1.0, 0.5, 0.4, 0.9],), ([1.0],), ([],)], "s array<double>")
    assert [r.a for r in df.select(rerank.field_score(F.col("s")).alias("a")).collect()] == pytest.approx([0.28, 0.4, 0.0])
    assert [r.a for r in df.select(rerank.top3_score(F.col("s")).alias("a")).collect()] == pytest.approx([0.6 + 0.225 + 0.075, 1.0, 0.0])


def test_fusion(spark) -> None:
    df = spark.createDataFrame([(0.8, 0.4, True, 2), (0.8, 0.4, True, 1), (0.8, 0.4, False, 2), (None, None, True, 2)], "t double, v double, e boolean, h int")
    assert [r.f for r in df.select(rerank.fuse(F.col("t"), F.col("v"), F.col("e"), F.col("h")).alias("f")).collect()] == pytest.approx([0.7, 0.62, 0.4, 0.0])


def test_min_max_and_metrics(spark) -> None:
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, s double")
    assert sorted((r.k, r.scaled) for r in rerank.min_max(df, "k", "s").collect()) == [("a", 0.0), ("a", 1.0), ("b", 0.0)]
    ranks = spark.createDataFrame([(1,), (2,), (9,), (None,)], "r int")
    m = rerank.evaluate(ranks, "r").first()
    assert (m.asked, m.top1, m.top5) == (4, 0.25, 0.5) and m.mrr == pytest.approx((1 + 0.5 + 1 / 9) / 4)


def test_near_equal_vectors_are_dropped(spark) -> None:
    df = spark.createDataFrame([("q", 1, [1.0, 0.0]), ("q", 2, [1.0, 0.0]), ("q", 3, [0.0, 1.0]), ("q", 4, [0.6, 0.8])], "q string, place int, v array<float>")
    assert [tuple(r) for r in rerank.drop_near_equal(df, "q", "place", "v", 2).collect()] == [("q", [1, 3])]


def test_near_equal_vectors_are_dropped_behind_many_copies(spark) -> None:
    rows = [("q", i, [1.0, 0.0, 0.0]) for i in range(60)] + [("q", 60, [0.0, 1.0, 0.0]), ("q", 61, [0.0, 1.0, 0.0]), ("q", 62, [0.0, 0.0, 1.0]), ("q", 63, [0.6, 0.8, 0.0])]
    rows += [(None, 5, [0.6, 0.8, 0.0]), (None, 6, [0.6, 0.8, 0.0]), ("r", 1, None), ("r", 2, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "q string, place int, v array<float>")
    got = {r.q: r.kept for r in rerank.drop_near_equal(df, "q", "place", "v", 4).collect()}
    assert got == {"q": [0, 60, 62, 63], None: [5], "r": [2]}


def test_catalog_csv(spark, tmp_path) -> None:
    (tmp_path / "c.csv").write_text('﻿Slug,Название вина,Винодельня\na,"Вино, первое",nan\na,Второе,Дом\n,Третье,\nb, Четвёртое ,\n', encoding="utf-8")
    out = files.read_catalog(spark, str(tmp_path / "c.csv"), {"Slug": "slug", "Название вина": "name", "Винодельня": "winery"})
    assert sorted((r.slug, r.name, r.winery, r.grape) for r in out.collect()) == [("a", "Вино, первое", "", ""), ("b", "Четвёртое", "", "")]


def test_images_and_json(spark, tmp_path) -> None:
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "card-1.png").write_bytes(b"abc")
    (tmp_path / "x" / "note.txt").write_bytes(b"abc")
    images = files.read_images(spark, str(tmp_path / "x"))
    assert [(r.slug, r.length) for r in images.select("slug", "length").collect()] == [("card-1", 3)]
    assert files.profile_files(images).first().extension == "png"
    (tmp_path / "r.json").write_text('[{"k": "a", "n": 1}, {"k": "b"}]')
    assert [tuple(r) for r in files.read_json_records(spark, str(tmp_path / "r.json"), "k string, n int").collect()] == [("a", 1), ("b", None)]


def test_json_lines_lose_no_record(spark, tmp_path) -> None:
    (tmp_path / "l.json").write_text('{"k": "a", "n": 1}\n{"k": "b"}\n{"k": "c", "n": 3}\n{"k": broken\n')
    read = lambda **k: files.read_json_records(spark, str(tmp_path / "l.json"), "k string, n int", **k)
    assert sorted(tuple(r) for r in read().collect()) == [("a", 1), ("b", None), ("c", 3)]
    assert [r.record for r in read(broken=True).collect()] == ['{"k": broken']
    assert sorted(tuple(r) for r in read(lines=True).collect()) == [("a", 1), ("b", None), ("c", 3)]
    (tmp_path / "e.json").write_text("")
    assert files.read_json_records(spark, str(tmp_path / "e.json"), "k string, n int").count() == 0


def test_public_view_hides_what_was_not_found(spark) -> None:
    df = spark.createDataFrame([(1, "found", "a", 0.98765, "N"), (2, "error", "a", None, "N")], "request int, status string, slug string, confidence double, name string")
    assert [tuple(r) for r in files.public_view(df, ["name"]).orderBy("request").collect()] == [(1, "found", "a", 0.9877, "N"), (2, "not_found", None, 0.0, "")]


def test_vectors_and_cache_come_back(spark, tmp_path) -> None:
    files.write_vectors(spark.createDataFrame([(0, "a", [3.0, 4.0]), (1, "b", [0.0, 0.0])], "row_idx long, slug string, embedding array<float>"), str(tmp_path / "v"))
    assert {r.slug: [round(x, 4) for x in r.embedding] for r in files.read_vectors(spark, str(tmp_path / "v")).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    old = spark.createDataFrame([("k", 1.0, 1)], "cache_key string, cached_at double, cache_id long")
    files.write_cache(old, spark.createDataFrame([("k", 2.0, 2)], old.schema), str(tmp_path / "c"))
    assert [r.cache_id for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [2]


def test_public_json(spark) -> None:
    df = spark.createDataFrame([(1, "qr", "found", "a", 0.2), (2, "visual", "found", None, 0.2)], "request int, method string, status string, slug string, confidence double")
    assert [r.body for r in files.public_json(df).orderBy("request").collect()] == ['{"method":"qr","status":"found","slug":"a","confidence":1.0}', '{"method":"visual","status":"found","confidence":0.2}']
