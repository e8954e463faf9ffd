"""A lookup cache with time to live, as batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
#: seconds that a lookup without a result stays valid if its row says nothing else
NEGATIVE_TTL = 604_800
NEGATIVE = ("not_found", "empty", "non_html")
# ---- end of fixed values ----


def latest(cache: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last entry of each key by time, then by the tie column; NULL times come first. A partial aggregate, so a hot key costs one row a task."""
    cols = [c for c in cache.columns if c not in (key, at, tie)]
    return cache.groupBy(key).agg(F.max(F.struct(at, tie, *cols)).alias("r")).select(key, "r.*")


def usable(now: float) -> Column:
    """Whether an entry may answer: found ones always, empty ones while their time to live lasts, failures never."""
    age = F.lit(now) - F.col("cached_at")
    alive = (F.coalesce("cached_at", F.lit(0.0)) > 0) & (age <= F.coalesce("negative_ttl", F.lit(NEGATIVE_TTL)))
    return F.coalesce((F.col("status") == "found") | (F.col("status").isin(*NEGATIVE) & alive), F.lit(False))


def upsert(cache: DataFrame, fresh: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The cache after new entries: the last one of each key stays."""
    return latest(cache.unionByName(fresh, allowMissingColumns=True), key, at, tie)


def first_filled(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row a key with the first non-empty value of each column in the given order; '' where none is."""
    picks = [F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*order))), F.lit("")).alias(c) for c in columns]
    return df.groupBy(key).agg(*picks)
