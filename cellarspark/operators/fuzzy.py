"""Dictionary joins: nearest entry with a lead over the runner-up, unique prefix, suffix, one-edit and wildcard matches.

All are equi-joins on keys that matching pairs must share, so neither side has to be small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: dictionary entries of one group that are compared at once, about, and words that meet them in one step
ENTRY_BLOCK, WORD_STEP = 2_000, 128


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step a letter."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|); 1 for two empty strings."""
    total = len(a) + len(b)
    return 1.0 if not total else 2.0 * lcs(a, b) / total


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of `parts` runs of nearly equal length."""
    short, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def shared_keys(word: str, least: float, window: int, entry: bool) -> set[int]:
    """Keys of a word or a dictionary entry; a word and an entry whose similarity reaches `least` share one.

    At most d letters of both are left out of their common subsequence, so of d + 1 runs of the entry one stands in the word as
    it is, shifted by no more letters than are left out before it.
    """
    out, n = set(), len(word)
    for other in range(max(1, n - window), n + window + 1):
        la, lb = (other, n) if entry else (n, other)
        d = int((1 - least) * (la + lb) + 1e-9)
        gone, extra = (d - la + lb) // 2, (d + la - lb) // 2
        if gone < 0 or extra < 0:
            continue
        parts = min(lb, gone + extra + 1)
        for i, (at, size) in enumerate(_cuts(lb, parts)):
            shifts = (0,) if entry else range(-gone, extra + 1)
            for k in shifts:
                if 0 <= at + k <= len(word) - size:
                    out.add(xxhash.xxh64_intdigest(f"{la} {lb} {i} {word[at + k : at + k + size]}") - (1 << 63))
    return out


def near_pairs(words: DataFrame, dictionary: DataFrame, word: str, key: str, least: float, window: int = 2) -> DataFrame:
    """(word, key, score) of the distinct pairs whose similarity reaches `least` and whose lengths differ by at most `window`.

    `least` must be above 0.6.  NULL and '' match nothing.  Two shuffles of short keys; the pairs that share one are compared.
    """
    if least <= 0.6:
        raise ValueError("the least similarity must be above 0.6")

    def keyed(entry: bool):  # noqa: ANN202
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(w, k) for w in b.column(0).to_pylist() for k in shared_keys(w, least, window, entry)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["w", "k"])

        return keys

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [indel(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[word, key, "score"])

    once = lambda df, c: df.select(F.col(c).alias("w")).where("w is not null and w <> ''").distinct()
    left = once(words, word).mapInArrow(keyed(False), "w string, k long")
    right = once(dictionary, key).mapInArrow(keyed(True), "w string, k long").withColumnRenamed("w", "d")
    # leaving out and putting in letters are edits too, so a near pair has no more edits; far pairs never leave their task
    most = F.floor((1 - least) * (F.length("w") + F.length("d")) + 1e-9)
    met = left.join(right, "k").where(F.levenshtein("w", "d") <= most).select("w", "d").distinct()
    return met.mapInArrow(compare, f"{word} string, {key} string, score double").where(F.col("score") >= least)


def _by_length(words: list[str], index: dict[str, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and letters (as numbers) of the words of each length."""
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    return {n: (np.array(rows), np.array([[index[c] for c in words[i]] for i in rows], dtype=np.intp).reshape(len(rows), n)) for n, rows in at.items()}


def close_pairs(words: list[str], entries: list[str], least: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in `words`, in `entries`, similarities) of all pairs whose similarity reaches `least` and whose lengths differ by
    at most `window`: the steps of `lcs` for all pairs of two lengths at once."""
    index = {c: i for i, c in enumerate(sorted(set("".join(words)) | set("".join(entries))))}
    of_length = _by_length(entries, index)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for la, (rows, letters) in _by_length(words, index).items():
        if not la:
            continue
        if la > 63:  # more letters than a number has bits
            slow = [(i, j, indel(words[i], entries[j])) for i in rows.tolist() for lb, (at, _) in of_length.items() if lb and abs(la - lb) <= window for j in at.tolist()]
            found += [(np.array([i]), np.array([j]), np.array([s])) for i, j, s in slow if s >= least]
            continue
        kind = np.uint32 if la < 32 else np.uint64
        full = kind((1 << la) - 1)
        masks = np.zeros((len(index), len(rows)), dtype=kind)
        for k in range(la):
            masks[letters[:, k], np.arange(len(rows))] |= kind(1 << k)
        for lb, (at, other) in of_length.items():
            if not lb or abs(la - lb) > window:
                continue
            for start in range(0, len(rows), WORD_STEP):
                own = masks[:, start : start + WORD_STEP]
                v = np.full((len(at), own.shape[1]), full, dtype=kind)
                for k in range(lb):
                    u = v & own[other[:, k]]
                    v = (v + u) | (v - u)
                score = 2.0 * (la - np.bitwise_count(v & full).astype(np.int64)) / (la + lb)
                e, w = np.nonzero(score >= least)
                found.append((rows[start + w], at[e], score[e, w]))
    empty = (np.zeros(0, dtype=np.intp), np.zeros(0, dtype=np.intp), np.zeros(0))
    i, j, s = (np.concatenate(x) for x in zip(empty, *found))
    return i, j, s


def near_pairs_within(words: DataFrame, dictionary: DataFrame, group: str, word: str, key: str, least: float, window: int = 2) -> DataFrame:
    """(group, word, key, score) of the distinct pairs of one group whose similarity reaches `least` and whose lengths differ by at
    most `window`.

    Only words and entries of the same group are compared.  The entries of a group are dealt to blocks of about ENTRY_BLOCK, which
    all words of the group meet, so no task holds the pairs of a large group.  NULL and '' match nothing.
    """
    said = lambda df, c: df.select(group, c).where(F.col(group).isNotNull() & (F.coalesce(c, F.lit("")) != "")).distinct()
    entries = said(dictionary, key)
    blocks = entries.groupBy(group).agg(F.ceil(F.count("*") / ENTRY_BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(blocks, group).select(group, key, F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"))
    asked = said(words, word).join(blocks, group).select(group, word, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compare(left, right):  # noqa: ANN001, ANN202
        import pandas as pd

        w, e = left[word].tolist(), right[key].tolist()
        i, j, s = close_pairs(w, e, least, window) if w and e else ([], [], [])
        text = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({group: text(left[group].iloc[:1].tolist() * len(i)), word: text([w[x] for x in i]), key: text([e[x] for x in j]), "score": pd.Series(s, dtype=float)})

    kinds = dict(words.dtypes)
    return asked.groupBy(group, "block").cogroup(dealt.groupBy(group, "block")).applyInPandas(compare, f"{group} {kinds[group]}, {word} string, {key} string, score double")


def margin_match(words: DataFrame, dictionary: DataFrame, word: str, key: str, least: float, lead: float, window: int = 2, always: bool = False) -> DataFrame:
    """(word, key, score) of each distinct word whose best entry reaches `least` and leads the second by `lead`.

    Entries whose length differs by more than `window` are not compared.  With `always` the lead is asked for whatever the
    second's score; else only where the second reaches `least` too.  NULL and '' match nothing, nor does an empty dictionary;
    of equal entries the smaller is best, and such a tie has no lead.
    """
    floor = least - lead if always else least
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), key)))
    ranked = near_pairs(words, dictionary, word, key, floor, window).groupBy(word).agg(best.alias("r"))
    first, second = -F.col("r")[0]["s"], F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0))
    leads = (first - second >= lead) | (F.lit(not always) & (second < least))
    return ranked.where((first >= least) & leads).select(word, F.col("r")[0][key].alias(key), first.alias("score"))


def _unique(words: DataFrame, entries: DataFrame, word: str, target: str, key: Column, fits: Column | None = None) -> DataFrame:
    """(word, target) of the distinct words whose keys meet entries (k, target) of exactly one target."""
    asked = words.select(word).where(f"{word} is not null and {word} <> ''").distinct().select(word, F.explode(key).alias("k"))
    met = asked.join(entries, "k")
    if fits is not None:
        met = met.where(fits)
    return met.groupBy(word).agg(F.min(target).alias(target), F.max(target).alias("__other")).where(F.col(target) == F.col("__other")).drop("__other")


def _entries(dictionary: DataFrame, key: str, target: str, keys: Column) -> DataFrame:
    """(k, entry, target), one row a key of each distinct entry."""
    once = dictionary.where(f"{key} is not null and {key} <> '' and {target} is not null").select(F.col(key).alias("entry"), target).distinct()
    return once.select(F.explode(F.array_distinct(keys)).alias("k"), "entry", target)


def unique_affix(words: DataFrame, dictionary: DataFrame, word: str, key: str, target: str, shortest: int, longer: int, suffix: bool = False, strict: bool = False) -> DataFrame:
    """(word, target) of each distinct word of `shortest` letters or more that begins (or ends) the entries of exactly one
    target, which are at most `longer` letters longer; an entry begins and ends itself unless `strict`."""
    n = F.length("entry")
    most = n - 1 if strict else n
    sizes = F.sequence(F.greatest(F.lit(shortest), n - longer), most)
    part = lambda k: F.substring(F.col("entry"), n - k + 1, k) if suffix else F.substring(F.col("entry"), F.lit(1), k)
    keys = F.when(most >= shortest, F.transform(sizes, part)).otherwise(F.array().cast("array<string>"))
    return _unique(words, _entries(dictionary, key, target, keys), word, target, F.array(word))


def _deletions(c: Column) -> Column:
    """A word and its spellings with one letter left out."""
    left_out = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), left_out))


def unique_one_edit(words: DataFrame, dictionary: DataFrame, word: str, key: str, target: str, shortest: int) -> DataFrame:
    """(word, target) of each distinct word of `shortest` letters or more that is one edit from the entries of exactly one target."""
    entries = _entries(dictionary, key, target, _deletions(F.col("entry")))
    return _unique(words.where(F.length(word) >= shortest), entries, word, target, _deletions(F.col(word)), F.levenshtein(word, "entry", 1) == 1)


def unique_wildcard(words: DataFrame, dictionary: DataFrame, word: str, key: str, target: str, stray: str, shortest: int) -> DataFrame:
    """(word, target) of each distinct word with one letter of the pattern `stray` that fits the entries of exactly one target
    when that letter is read as any."""
    n = F.length("entry")
    holes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col("entry"), F.lit(1), i - 1), F.lit("_"), F.substring(F.col("entry"), i + 1, n)))
    seen = words.where((F.length(word) >= shortest) & (F.regexp_count(word, F.lit(stray)) == 1))
    return _unique(seen, _entries(dictionary, key, target, holes), word, target, F.array(F.regexp_replace(word, stray, "_")))
