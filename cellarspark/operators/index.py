"""Token postings, document frequencies and scores over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarspark.functions import text as T
from cellarspark.sources.tables import cell

#: a task holds so many cards of a word at once
CARD_BLOCK = 32_768


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key that is not missing, by the order column; one partial aggregate, no sort."""
    cols = [c for c in df.columns if c not in (key, order)]
    kept = df.where(cell(key) != "")
    return kept.groupBy(key).agg(F.min(F.struct(order, *cols)).alias("r")).select(key, "r.*")


def postings(catalog: DataFrame, fields: dict[str, str], row: str = "slug") -> DataFrame:
    """Distinct (kind, token, row): the tokens of each field."""
    parts = [F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), T.tokens(col).alias("tokens")) for kind, col in fields.items()])).alias("p")]
    each = catalog.select(row, *parts)
    return each.select(F.col("p.kind").alias("kind"), F.explode("p.tokens").alias("token"), row).distinct()


def idf(df: Column, total: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1; a token that no row has weighs most."""
    return F.log((total + 1) / (df + 1)) + 1


def token_frequencies(catalog: DataFrame, fields: dict[str, str], row: str = "slug") -> DataFrame:
    """(token, df, idf): in how many rows a token occurs in any field."""
    post = postings(catalog, fields, row).select("token", row).distinct()
    total = F.broadcast(catalog.agg(F.greatest(F.count("*"), F.lit(1)).alias("total")))  # one row
    return post.groupBy("token").agg(F.count("*").alias("df")).crossJoin(total).select("token", "df", idf(F.col("df"), F.col("total")).alias("idf"))


def rare_tokens(freq: DataFrame, most: int = 12, shortest: int = 5) -> DataFrame:
    """The rows of `freq` whose token has few owners."""
    return freq.where((F.col("df") <= most) & (F.length("token") >= shortest))


def rare_scores(asked: DataFrame, post: DataFrame, freq: DataFrame, ask: str, row: str, most: int = 12, shortest: int = 5) -> DataFrame:
    """(ask, row, score, hits): summed idf of the rare tokens that an ask and a row share.

    A token with more owners than `most` brings no candidates, so an ask meets at most `most` rows a token.
    """
    owners = post.select("token", row).distinct().join(rare_tokens(freq, most, shortest), "token")
    return asked.select(ask, "token").distinct().join(owners, "token").groupBy(ask, row).agg(F.sum("idf").alias("score"), F.count("*").alias("hits"))


def sets_on_cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the sets that a card owns.  Rows (token, words, all) come by token: first the sets with it, then, without words,
    what else each of its cards owns."""
    token, sets, cards = None, [], set()

    def meet() -> Iterator[list]:
        """Gives out the sets found; they go, and so do the cards."""
        nonlocal sets, cards
        places = {x: set() for _, every in sets for x in every}
        for i, own in enumerate(cards):
            for x in own:
                if x in places:
                    places[x].add(i)
        left = []
        for words, every in sets if cards else ():
            rest = sorted((places[x] for x in every if x != token), key=len)
            if not rest or set.intersection(*rest):
                yield words
            else:
                left.append((words, every))
        sets, cards = left, set()

    for b in batches:
        found, kind = [], b.schema.field(1).type
        for t, words, every in zip(b.column(0).to_pylist(), *map(_lists, b.columns[1:])):
            if t != token:
                found += meet()
                token, sets = t, []
            if words is not None:
                sets.append((words, every))
            elif sets:
                cards.add(tuple(every))
                if len(cards) >= CARD_BLOCK:
                    found += meet()
        yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["words"])
    if found := list(meet()):
        yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["words"])


def _lists(column: pa.ListArray) -> list[list | None]:
    """The lists of a column; numbers faster than to_pylist does."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), pc.cumulative_sum(pc.fill_null(pc.list_value_length(column), 0)).to_pylist()
    return [flat[a:e] if there else None for a, e, there in zip([0, *ends], ends, column.is_valid().to_pylist())]


def greedy_intersection(sets: DataFrame, row: str, terms: list[str]) -> DataFrame:
    """Rows that carry the terms, taken in the given order; a term that would leave nothing is skipped.

    One semi join a term; the driver only learns whether a step left something.
    """
    kept: DataFrame | None = None
    for t in terms:
        own = sets.where(F.col("token") == t).select(row).distinct()
        nxt = own if kept is None else kept.join(own, row, "left_semi")
        if not nxt.isEmpty():
            kept = nxt
    return kept if kept is not None else sets.select(row).limit(0)


def top_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
