"""Queries of boxes, and of vectors through a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.operators import boxes as B
from cellarspark.operators import vectors
from cellarspark.plans.registry import query
from cellarspark.sources.tables import table

_W, _H = 100, 120
_EACH = "(SELECT l_orderkey AS picture, l_linenumber AS line, CAST(l_quantity AS INT) AS x1, CAST(round(l_discount * 500) AS INT) AS y1, CAST(l_quantity AS INT) + 6 + 5 * l_linenumber AS x2, CAST(round(l_discount * 500) AS INT) + 60 - 4 * l_linenumber AS y2 FROM lineitem)"
_BOXES = f"(SELECT picture, row_number() OVER (PARTITION BY picture ORDER BY line, x1, y1, x2, y2) AS i, x1, y1, x2, y2 FROM {_EACH})"


def picture_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """(picture, boxes): up to seven boxes a picture, made from order lines."""
    x1, y1, n = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 500).cast("int"), F.col("l_linenumber").cast("int")
    each = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("picture"), n.alias("i"), B.box(x1, y1, x1 + 6 + 5 * n, y1 + 60 - 4 * n).alias("b"))
    return each.groupBy("picture").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda r: r["b"]).alias("boxes"))


_PX, _PY = int(_W * 0.04), int(_H * 0.04)


@query(f"""
WITH b AS (SELECT *, max(x2 - x1) OVER (PARTITION BY picture) AS widest, count(*) OVER (PARTITION BY picture) AS n FROM {_BOXES}), k AS (SELECT *, NOT (x2 - x1 < {B.PART_OF_PICTURE} * {_W} AND x2 - x1 < widest * {B.PART_OF_WIDEST}) OR n < 2 AS keep FROM b),
d AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, sqrt((((x1 + x2) / 2.0 - {_W / 2}) / {_W}) ** 2 + (((y1 + y2) / 2.0 - {_H / 2}) / {_H}) ** 2) AS off FROM k WHERE keep),
s AS (SELECT *, round(area * (1 - {B.OFF_CENTRE} * least(off, 1)), 6) AS worth FROM d), c AS (SELECT picture, count(*) AS kept, arg_min(s, struct_pack(w := -worth, i := i)) AS best, arg_min(s, struct_pack(a := -area, i := i)) AS large FROM s GROUP BY 1),
r AS (SELECT picture, kept, CASE WHEN best.area < large.area * {B.LARGE_ENOUGH} THEN large ELSE best END AS b FROM c), u AS (SELECT picture, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {_BOXES} GROUP BY 1)
SELECT picture, kept, b.x1 AS x1, b.y1 AS y1, greatest(0, b.x1 - {_PX}) AS pad_x1, least({_H}, b.y2 + {_PY}) AS pad_y2, greatest(0, least({_W}, CAST(floor(b.x2 * 0.5) AS INT))) AS half_x2, round(b.area / {_W * _H}.0, 6) AS covered, (u.x2 - u.x1) * (u.y2 - u.y1) AS around FROM r JOIN u USING (picture)""")
def box_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The box that stands for each picture, with its padded and scaled forms, how much it covers and the box around all."""
    p = picture_boxes(spark, folder).withColumn("kept", B.drop_parts(F.col("boxes"), _W)).withColumn("b", B.choose(F.col("kept"), _W, _H))
    b = F.col("b")
    return p.select(
        "picture", F.size("kept").cast("long").alias("kept"), b["x1"].alias("x1"), b["y1"].alias("y1"), B.pad(b, _W, _H, 0.04)["x1"].alias("pad_x1"), B.pad(b, _W, _H, 0.04)["y2"].alias("pad_y2"), B.scale(b, 0.5, _W, _H)["x2"].alias("half_x2"),
        F.round(B.coverage(b, _W, _H), 6).alias("covered"), B.area(B.union(F.col("boxes"))).alias("around"),
    )


@query()
def box_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The boxes of each picture with overlapping ones as one."""
    out = B.merge_overlaps(picture_boxes(spark, folder), "picture", "boxes")
    return out.select("picture", F.posexplode("boxes").alias("at", "b")).select("picture", "at", "b.*")


_OUT = 4
_CELL = "((i - 1) * 7 + (j - 1) * 3) % 5 - 2"
_DOT = f"list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * ({_CELL})))"


@query(f"""
WITH p AS (SELECT vec_id, j - 1 AS pos, {_DOT} AS x FROM embeddings, (SELECT unnest(generate_series(1, {_OUT})) AS j)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM p GROUP BY 1)
SELECT vec_id, pos, round(CASE WHEN norm = 0 THEN x ELSE x / norm END, 6) AS value FROM p JOIN n USING (vec_id)""")
def vector_project(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector through a linear head, as a unit vector."""
    e = table(spark, folder, "embeddings")
    head = [[float(((i * 7 + j * 3) % 5) - 2) for j in range(_OUT)] for i in range(64)]
    out = vectors.project(e, "vec_id", "embedding", head)
    return out.select("vec_id", F.posexplode("vec").alias("pos", "value")).select("vec_id", "pos", F.round("value", 6).alias("value"))
