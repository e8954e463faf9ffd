"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with this part of the rows is hot; there are at most its inverse in number
HOT = 1 / 512


def join_even(df: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`df` joined with a table that has each key once; how is inner or left.

    The rows of hot keys meet their (at most 512) rows of the table by broadcast and are never shuffled; the others are
    joined as Spark plans it.  Costs one count of the keys beforehand.  NULL keys match nothing.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = df.count()
    hot = [r[0] for r in counts.where(F.col("n") > HOT * total).select(key).collect()] if total else []
    if not hot:
        return df.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.where(is_hot).join(F.broadcast(unique.where(F.col(key).isin(hot))), key, how).unionByName(df.where(~is_hot).join(unique.where(~F.col(key).isin(hot)), key, how))
