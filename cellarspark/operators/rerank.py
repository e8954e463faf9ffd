"""Learned and hand-weighted fusion of candidate scores, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarspark.operators.joins import join_even
from cellarspark.plans.lineage import cut

#: numbers of a packed head: 6 weights, a bias, 6 means, 6 deviations
PACKED = 19


def logistic(features: list[Column], packed: list[float]) -> Column:
    """Score of a logistic head over standardised features; deviations below 1e-6 count as 1. A head of another size is refused."""
    if len(packed) != PACKED or len(features) != 6:
        raise ValueError(f"a head has {PACKED} numbers and 6 features")
    weight, bias, mean, std = packed[:6], packed[6], packed[7:13], packed[13:]
    z = F.lit(float(bias))
    for x, w, m, s in zip(features, weight, mean, std):
        z = z + w * (F.coalesce(x, F.lit(0.0)) - m) / (s if s >= 1e-6 else 1.0)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def field_score(scores: Column) -> Column:
    """Mean of the four best matches over 2.5, at most 1; 0 for none."""
    top = F.slice(F.sort_array(scores, asc=False), 1, 4)
    return F.when(F.size(top) > 0, F.least(F.lit(1.0), F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top) / 2.5)).otherwise(0.0)


def top3_score(scores: Column) -> Column:
    """Three best scores by weights .60 .25 .15, two by .70 .30, one as it is; 0 for none."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(s) >= 3, 0.60 * s[0] + 0.25 * s[1] + 0.15 * s[2]).when(F.size(s) == 2, 0.70 * s[0] + 0.30 * s[1]).when(F.size(s) == 1, s[0]).otherwise(0.0)


def fuse_exact(text: Column, visual: Column, exclusive: Column, hits: Column) -> Column:
    """Fused score from 0 to 1: text weighs more with two distinctive hits; candidates that are not exclusive keep the visual score."""
    t, v = F.coalesce(text, F.lit(0.0)), F.coalesce(visual, F.lit(0.0))
    raw = F.when(exclusive & (hits >= 2), 0.25 * v + 0.75 * t).when(exclusive, 0.65 * v + 0.35 * t + F.when(t > 0, 0.10 * t).otherwise(0.0)).otherwise(v)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def fuse(text: Column, visual: Column, exclusive: Column, hits: Column) -> Column:
    """`fuse_exact` to four places."""
    return F.bround(fuse_exact(text, visual, exclusive, hits), 4)


def min_max(df: DataFrame, key: str, score: str) -> DataFrame:
    """The rows with `scaled`: the score within its key from 0 to 1; 0 where all are equal. Aggregated before it is joined, so a hot key is no one task's work."""
    bounds = df.groupBy(key).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return join_even(df, bounds, key).withColumn("scaled", F.when(span > 0, (F.col(score) - F.col("__lo")) / span).otherwise(0.0)).drop("__lo", "__hi")


def evaluate(ranks: DataFrame, rank: str) -> DataFrame:
    """(asked, top1, top5, mrr) over the ranks of the true rows; a NULL rank is a miss."""
    r = F.col(rank)
    return ranks.agg(
        F.count("*").alias("asked"),
        F.avg(F.coalesce(r == 1, F.lit(False)).cast("int")).alias("top1"),
        F.avg(F.coalesce(r <= 5, F.lit(False)).cast("int")).alias("top5"),
        F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"),
    )


def drop_near_equal(candidates: DataFrame, key: str, order: str, vec: str, limit: int, same: float = 0.9999) -> DataFrame:
    """(key, kept): up to `limit` candidates of each key in order, each unlike all kept before it; rows without a vector are left out.

    A round finds the first candidate of each key after the last one kept that is unlike all kept so far, so a key is full or
    exhausted in the end, however many copies it holds; a round reads the candidates once and aggregates before it shuffles.
    """
    rows = candidates.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.struct(F.col(order).alias("o"), F.col(vec).alias("v")).alias("x"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    kept = cut(rows.groupBy("k").agg(F.min("x").alias("x")).select("k", F.array("x").alias("kept")))
    for _ in range(limit - 1):
        near = F.exists("kept", lambda y: F.coalesce(dot(y["v"], F.col("x.v")) >= same, F.lit(False)))
        left = rows.join(kept.withColumnRenamed("k", "of"), F.col("k").eqNullSafe(F.col("of"))).where((F.col("x") > F.element_at("kept", -1)) & ~near)
        found = cut(left.groupBy("k").agg(F.min("x").alias("next")).withColumnRenamed("k", "of"))
        if found.isEmpty():
            break
        grown = F.when(F.col("next").isNotNull(), F.concat("kept", F.array("next"))).otherwise(F.col("kept"))
        kept = cut(kept.join(found, F.col("k").eqNullSafe(F.col("of")), "left").select("k", grown.alias("kept")))
    return kept.select(F.col("k").alias(key), F.transform("kept", lambda x: x["o"].cast("bigint")).alias("kept"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, rounds: int = 60, rate: float = 1.0, ridge: float = 1e-4) -> list[float]:
    """The packed head of a logistic curve over standardised features (weights, bias, means, deviations).

    Full-batch gradient steps; each is one aggregate of as many sums as features, whatever the number of rows.  Rows with a NULL
    label are left out, NULL features count as 0; no rows or one class give weights of 0.
    """
    known = cut(rows.where(F.col(label).isNotNull()).select(*[F.coalesce(F.col(f), F.lit(0.0)).cast("double").alias(f"x{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("y")))
    xs = [f"x{k}" for k in range(len(features))]
    stats = known.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(x).alias(f"m_{x}") for x in xs], *[F.stddev_pop(x).alias(f"s_{x}") for x in xs]).first()
    n = stats["n"]
    mean = [float(stats[f"m_{x}"] or 0.0) for x in xs]
    std = [float(stats[f"s_{x}"] or 0.0) for x in xs]
    w, b = [0.0] * len(xs), 0.0
    if n and 0.0 < stats["y"] < 1.0:
        z = [(F.col(x) - m) / (s if s >= 1e-6 else 1.0) for x, m, s in zip(xs, mean, std)]
        for _ in range(rounds):
            raw = F.lit(b)
            for x, k in zip(z, w):
                raw = raw + x * k
            miss = 1 / (1 + F.exp(-raw)) - F.col("y")
            grad = known.agg(F.avg(miss).alias("b"), *[F.avg(miss * x).alias(f"g{k}") for k, x in enumerate(z)]).first()
            b -= rate * grad["b"]
            w = [k - rate * (grad[f"g{i}"] + ridge * k) for i, k in enumerate(w)]
    return [*w, b, *mean, *std]
