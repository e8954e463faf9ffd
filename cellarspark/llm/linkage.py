"""P2: match the pages of one table to the records of another that shares no key with it.

Both sides become sets of terms over all attributes (label words, their one-letter deletions in Latin and in the own script,
maker, grape), and records are ranked by the BM25 weight of the terms they share with a page.  Rare terms meet in buckets by
their key, so pages and records are never paired there unless they share one.  Of the few terms that many records own (words of
a line, makers, grapes) a page's two best records are searched among the records of each of its frequent label words, by
intersections of their owners and a bound on what is left.  Records met either way get their whole score, so the two best
are exact however many records own a term.
The best record is kept if the page is also near the record's own best
(mutual-nearest test) and if the confidence is high enough: a logistic curve of the score gap and of the parts of the label
that the page's name and the whole page cover, calibrated on a bounded sample labelled by an exact comparison of words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarspark.llm import boilerplate, lookalike, mojibake
from cellarspark.llm.canonical import Trie, romanise
from cellarspark.plans.lineage import cut

# ---- fixed values: colours by their words, words of shops and forms of firms ----
COLOURS = {"beloe": ("бел", "bel", "white", "blanc"), "krasnoe": ("красн", "krasn", "red", "rouge"), "rozovoe": ("розов", "rozov", "rose"), "oranzhevoe": ("оранж", "oranzh", "orange")}
SHADES = {"соломенный": "beloe", "золотистый": "beloe", "рубиновый": "krasnoe", "гранатовый": "krasnoe", "лососёвый": "rozovoe", "медный": "rozovoe", "янтарный": "oranzhevoe"}
NOISE = frozenset(
    "вино вина вин wine российское россия купить цена цене цены магазине магазинах каталог винный отзывы описание подарочной коробке рублей от по в и на с г мл л "
    "сухое полусухое сладкое полусладкое брют vino reserve cuvee cuvée каталог история хозяйства винодельня winery регион ооо ао кфх море роса".split()
)
# ---- end of fixed values ----

K1 = 1.2
#: weight of a one-letter deletion beside a whole word
DELETION = 0.35
#: the page's score with its best record, as a part of the best score that record has with any page
MUTUAL = 0.15
#: records whose rare terms share a bucket, and pages that meet a bucket at once
RECORD_BLOCK, PAGE_BLOCK = 4_000, 4_000
#: owners from which a label word, maker or grape is frequent, and how many may be (they are sent to every worker)
FREQUENT, MOST_FREQUENT = 32, 50_000
#: parts of the pages that search the records of a frequent word
PARTS_OF_WORD = 2
#: weights are whole numbers of this part, so that equal sums are equal in any order
UNIT = 1 / (1 << 20)
#: pairs of pages and records sent on at once
PAIRS = 500_000
#: postings of a block from which a term's weights are kept as a vector over the block
DENSE = 2_000
#: a pair is a match from this confidence on
CONFIDENT = 0.5
#: what the confidence is read from
EVIDENCE = ("gap", "cover", "cover * cover", "told", "cover * told", "gap * cover")
#: rows on which the confidence curve is fitted, about
CALIBRATION_ROWS = 20_000

_WORD = re.compile(r"[^\W\d_]+")
_TITLE = re.compile(r"[A-ZА-ЯЁ][^\W\d_]+(?: [A-ZА-ЯЁ][^\W\d_]+){1,4}")
_STEP = re.compile(r"\s[|·»>→•/]\s")
_KIND = re.compile(r"Категория и цвет\s*[—–:-]\s*([^;\n]+)")
_MAKER = re.compile(r"Производитель\s*[:—–-]\s*([^;\n]+)")
_SLUG = re.compile(r"/([a-z]+(?:-[a-z]+){1,7})(?:-\d+)?/?$")


@lru_cache(maxsize=50_000)
def colour_of(text: str | None) -> str:
    """The one colour that a text names, '' for none or several."""
    low = (text or "").lower()
    found = {k for k, stems in COLOURS.items() if any(s in low and re.search(rf"(?<![^\W\d_]){s}", low) for s in stems)}
    return found.pop() if len(found) == 1 else ""


@lru_cache(maxsize=50_000)
def _latin(word: str) -> str | None:
    return None if word.lower() in NOISE else romanise(word)


def words_of(text: str | None) -> list[str]:
    """Words in Latin spelling, without shop words."""
    return [x for w in _WORD.findall(text or "") if (x := _latin(w)) is not None]


@lru_cache(maxsize=50_000)
def deletions(word: str) -> tuple[str, ...]:
    """The word and its spellings with one letter left out; two words one edit apart share one of them."""
    return tuple(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def own_script(words: list[str]) -> list[str]:
    """Deletion terms of words in their own script: one wrong Cyrillic letter may be two or more Latin ones."""
    return [f"c:{k}" for w in words if len(w) >= 5 and romanise(w) != w.lower() for k in deletions(w.lower())]


def term_key(term: str) -> int:
    """A term as a number, by which both sides meet."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=50_000)
def _keys(kind: str, word: str) -> tuple[int, ...]:
    """The term keys of a page's word: l its spelling and deletions, c its deletions in its own script, any other kind itself."""
    if kind == "l":
        return tuple(map(term_key, [f"l:{word}", *(f"d:{k}" for k in (deletions(word) if len(word) >= 5 else ()))]))
    return tuple(map(term_key, own_script([word]) if kind == "c" else [f"{kind}:{word}"]))


def keys_of(kind: str, words: list[str]) -> list[int]:
    return [k for w in words for k in _keys(kind, w)]


def slug_label(slug: str | None) -> list[str]:
    """The label's words in an address: without a copy's number and a colour at the end."""
    parts = [p for p in (slug or "").lower().split("-") if p]
    while len(parts) > 1 and (parts[-1].isdigit() or parts[-1] in COLOURS):
        parts.pop()
    return parts


def record_terms(slug: str | None, name: str | None, winery: str | None, grape: str | None) -> tuple[str, list[str]]:
    """(the label in Latin spelling, terms) of a record."""
    label = slug_label(slug) or [w for w in words_of(name) if w not in COLOURS]
    # words that name the maker tell nothing about which of its labels this is
    house = set(words_of(winery))
    label = [w for w in label if w not in house] or label
    terms = [f"l:{w}" for w in label]
    terms += [f"d:{k}" for w in label[-1:] if len(w) >= 5 for k in deletions(w)]
    terms += own_script([w for w in _WORD.findall(name or "") if label and romanise(w) == label[-1]][:1])
    terms += [f"m:{w}" for w in words_of(winery)] + [f"g:{w}" for w in words_of(grape) if len(w) > 3]
    return " ".join(label), list(dict.fromkeys(terms))


def headings(text: str, own: frozenset[str]) -> list[str]:
    """The titles a page gives itself: lines, or the last steps of a row of links, that are a name of two to five words found
    in the page's own fields (`own`, their letter triples)."""
    out = []
    for line in text.split("\n"):
        if not line.rstrip()[-1:].isalnum():
            continue
        piece = _STEP.split(" ".join(line.split()))[-1]
        if piece[:1].isupper() and _TITLE.fullmatch(piece) and piece not in out:
            t = boilerplate.triples(piece)
            if len(t & own) >= boilerplate.OWN * len(t):
                out.append(piece)
    return out


def page_terms(name: str, winery: str, colour: str, grape: str, address: str, text: str) -> tuple[list[int], int, dict]:
    """(keys of all terms, how many of them, the first ones, are the name's, evidence for the calibration) of a page of restored, unified fields."""
    m = _SLUG.search(address or "")
    path = slug_label(m[1]) if m else []
    words = words_of(name)
    titles = headings(text, boilerplate.triples(" ".join([name, *path])))
    title = [romanise(w) for t in titles for w in t.split()]
    label = list(dict.fromkeys([*words, *title, *path]))
    said = keys_of("l", words) + keys_of("c", [w for w in _WORD.findall(name) if w.lower() not in NOISE])
    maker = _MAKER.search(text)
    every = said + keys_of("l", label) + keys_of("c", [w for t in titles for w in t.split()])
    every += keys_of("m", [*words, *words_of(winery), *words_of(maker[1] if maker else "")])
    every += keys_of("g", [w for w in [*words, *words_of(grape)] if len(w) > 3])
    kind = _KIND.search(text)
    told = colour_of(kind[1]) if kind else ""
    return list(dict.fromkeys(every)), len(dict.fromkeys(said)), {"words": " ".join(words), "title": " ".join(romanise(w) for w in titles[0].split()) if titles else "", "colour": told or colour_of(name) or colour_of(colour)}


def near(word: str, target: str, most: int) -> bool:
    """Whether two words are within `most` edits."""
    if word == target:
        return True
    if abs(len(word) - len(target)) > most:
        return False
    return bool(Trie([]).add(target, 1).search(word, most))


def same_label(label: str, words: str, title: str) -> bool:
    """Whether a name's words are those of a label by an exact comparison: all of them, or the last within two edits (three
    where the page's title is the label) and the others within one or two."""
    parts, said = label.split(), words.split()
    if not parts:
        return False
    if all(p in said for p in parts):
        return True
    proper = parts[-1]
    if title == label:
        return any(near(w, proper, 3 if len(proper) > 7 else 2) for w in said)
    close = any(near(w, proper, 2 if len(proper) > 6 else 1) for w in said)
    return close and all(any(near(w, p, 2 if len(p) > 5 else 1) for w in said) for p in parts[:-1])


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept first) of a logistic curve by Newton's method with a small ridge; a flat curve where y has one value."""
    x = np.asarray(x, dtype=float)
    w = np.zeros(x.shape[1] + 1)
    if len(y) == 0 or y.min() == y.max():
        w[0] = 4.0 if len(y) and y.max() == 1 else -4.0
        return w
    a = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(a.shape[1])
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def records(catalog: DataFrame) -> DataFrame:
    """(row_idx, label, maker, colour, terms, kinds) of every card: the keys of its terms and their kinds.

    Of repeated slugs the row with the smallest row_idx counts; rows without a slug count each for itself.
    """
    key = F.when(F.coalesce(F.trim("slug"), F.lit("")) == "", F.concat(F.lit("\u0000"), F.col("row_idx").cast("string"))).otherwise(F.col("slug"))
    cols = ("slug", "name", "winery", "grape", "color", "category")
    first = catalog.groupBy(key.alias("k")).agg(F.min(F.struct("row_idx", *cols)).alias("r")).select("r.*")
    counts = lookalike.character_counts(catalog, "name")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = lookalike.Normaliser(counts)
        for b in batches:
            out = []
            for r in b.to_pylist():
                name = lookalike.normalise(r["name"], norm)[0] or ""
                label, terms = record_terms(r["slug"], name, r["winery"], r["grape"])
                colour = colour_of(r["category"]) or colour_of(name) or SHADES.get((r["color"] or "").strip().lower(), "")
                maker = " ".join(words_of(r["winery"]))
                out.append({"row_idx": r["row_idx"], "label": label, "maker": maker, "colour": colour, "terms": [term_key(t) for t in terms], "kinds": [t[0] for t in terms]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row_idx", pa.int64()), ("label", pa.string()), ("maker", pa.string()), ("colour", pa.string()), ("terms", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string()))]))

    return first.mapInArrow(build, "row_idx long, label string, maker string, colour string, terms array<long>, kinds array<string>").where("label <> ''")


def weight(df: np.ndarray, total: int, lesser: np.ndarray | bool) -> np.ndarray:
    """The BM25 idf of terms with `df` of all records (term frequency one) in UNITs; deletions (`lesser`) weigh less."""
    idf = np.log(1 + (float(total) - df + 0.5) / (df + 0.5)) * np.where(lesser, DELETION, 1.0)
    return np.maximum(1, np.rint(idf / UNIT)).astype(np.int64)


def frequent_terms(owned: DataFrame, total: int) -> dict[int, tuple[int, bool]]:
    """term: (weight, whether it is a label word) of the frequent ones among distinct (record, term, kind)."""
    from_ = max(FREQUENT, owned.count() // MOST_FREQUENT)
    rows = owned.groupBy("term", "kind").agg(F.count("*").alias("df")).where(F.col("df") > from_).collect()
    return {r.term: (int(weight(np.array([r.df]), total, False)[0]), r.kind == "l") for r in rows}


def _flat(column: pa.Array, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """(values, their rows) of a list column's part."""
    some = column.slice(part.start, part.stop - part.start)
    sizes = np.diff(some.offsets.to_numpy())
    return some.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


#: packed (bucket, side, keys, owners, marks): terms, who has them, and the kind of a record's or whether a page's name has it
BUCKETS = pa.schema([("bucket", pa.int32()), ("side", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("marks", pa.binary())])
PAIR = pa.schema([("page", pa.int64()), ("record", pa.int64()), ("sum", pa.int64()), ("label", pa.int64()), ("named", pa.int64())])
PAIR_SQL = "page long, record long, sum long, label long, named long"


def _dealt(keys: np.ndarray, owners: np.ndarray, marks: np.ndarray, buckets: int, side: int) -> pa.RecordBatch:
    bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    which, starts = np.unique(bucket[order], return_index=True)
    cuts = [order[i:j] for i, j in zip(starts, [*starts[1:], len(order)])]
    packed = [pa.array([np.ascontiguousarray(x[c]).tobytes() for c in cuts], pa.binary()) for x in (keys, owners, marks)]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.full(len(which), side), pa.int32()), *packed], schema=BUCKETS)


def rare_pairs(asked: DataFrame, cards: DataFrame, often: dict[int, tuple[int, bool]], total: int) -> DataFrame:
    """PAIR rows of pages and the records with which they share a term that is not in `often`; each pair as often as it shares
    buckets, with the weights of the terms in it.  `asked` has (page, keys, said), `cards` (record, terms, kinds)."""
    buckets = max(1, -(-total // RECORD_BLOCK))
    known = np.array(sorted(often), dtype=np.int64)

    def records_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, row = _flat(b.column("terms"), slice(0, b.num_rows))
            kinds, _ = _flat(b.column("kinds"), slice(0, b.num_rows))
            rare = ~np.isin(keys, known)
            mark = np.array([ord(k) for k in kinds], dtype=np.uint8)
            yield _dealt(keys[rare], b.column("record").to_numpy()[row[rare]], mark[rare], buckets, 0)

    def pages_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PAGE_BLOCK):
                part = slice(i, min(b.num_rows, i + PAGE_BLOCK))
                keys, row = _flat(b.column("keys"), part)
                nth = np.arange(len(keys)) - np.searchsorted(row, row)
                yield _dealt(keys, b.column("page").to_numpy()[part][row], (nth < b.column("said").to_numpy()[part][row]).astype(np.uint8), buckets, 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, index = None, [], None
        read = lambda b, i: [np.frombuffer(b.column(c)[i].as_buffer(), dtype=t) for c, t in (("keys", np.int64), ("owners", np.int64), ("marks", np.uint8))]
        for b in batches:
            for i in range(b.num_rows):
                if b.column("bucket")[i].as_py() != number:
                    number, held, index = b.column("bucket")[i].as_py(), [], None
                if b.column("side")[i].as_py() == 0:
                    held.append([x.copy() for x in read(b, i)])
                elif held or index is not None:
                    if index is None:
                        index, held = _rare_index(*map(np.concatenate, zip(*held)), total), []
                    yield from _met(*index, *read(b, i))

    shape = "bucket int, side int, keys binary, owners binary, marks binary"
    both = cards.select("record", "terms", "kinds").mapInArrow(records_, shape).unionByName(asked.select("page", "keys", "said").mapInArrow(pages_, shape))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "side").mapInArrow(meet, PAIR_SQL)


def _rare_index(keys: np.ndarray, owners: np.ndarray, kinds: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """(terms, starts, owners, weights, labelled) of a bucket's postings, each once."""
    order = np.lexsort((owners, keys))
    keys, owners, kinds = keys[order], owners[order], kinds[order]
    first = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))[: len(keys)]
    keys, owners, kinds = keys[first], owners[first], kinds[first]
    terms, starts = np.unique(keys, return_index=True)
    kind = kinds[starts]
    starts = np.append(starts, len(keys))
    lesser = np.isin(kind, [ord(k) for k in "dc"])
    return terms, starts, owners, weight(np.diff(starts), total, lesser), lesser | (kind == ord("l"))


def _met(terms: np.ndarray, starts: np.ndarray, owners: np.ndarray, weights: np.ndarray, labelled: np.ndarray, keys: np.ndarray, pages: np.ndarray, named: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(terms):
        return
    at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == keys)
    at = at[hit]
    n = starts[at + 1] - starts[at]
    ends = np.cumsum(n)
    i = 0
    while i < len(hit):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        size = n[i:j]
        row = np.repeat(starts[at[i:j]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        w = np.repeat(weights[at[i:j]], size)
        label = np.where(np.repeat(labelled[at[i:j]], size), w, 0)
        said = np.where(np.repeat(named[hit[i:j]] > 0, size), label, 0)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.repeat(pages[hit[i:j]], size), owners[row], w, label, said)], schema=PAIR)
        i = j


def best_owners(owners: list[tuple[int, int]], rest: int, sure: int) -> list[tuple[int, int]]:
    """(weight, position) of the two heaviest positions; equal weights go to the smaller one.

    `owners` has (weight, positions as bits) of terms; a position weighs `sure` and the terms that have it, `rest` are all
    positions as bits.  A branch takes a term or leaves it; it ends where no position is left or where all terms left
    could not reach the second best.
    """
    owners = sorted((x for x in owners if x[1]), key=lambda x: -x[0])
    left = [0] * (len(owners) + 1)
    for i in range(len(owners) - 1, -1, -1):
        left[i] = left[i + 1] + owners[i][0]
    best: list[tuple[int, int]] = []
    stack = [(0, rest, sure)]
    while stack:
        i, now, w = stack.pop()
        while i < len(owners) and not (len(best) == 2 and w + left[i] < -best[1][0]):
            both = now & owners[i][1]
            if both:
                # with the term first; without it later
                stack.append((i + 1, now, w))
                now, w = both, w + owners[i][0]
            i += 1
        if i < len(owners) or len(best) == 2 and w < -best[1][0]:
            continue
        for _ in range(2):
            if not now:
                break
            low = now & -now
            at = low.bit_length() - 1
            if all(at != y for _, y in best):
                best = sorted([*best, (-w, at)])[:2]
            now ^= low
    return [(-w, at) for w, at in best]


def frequent_pairs(asked: DataFrame, owned: DataFrame, often: dict[int, tuple[int, bool]]) -> DataFrame:
    """PAIR rows, with sums of 0, of each page and the two records that weigh most by terms of `often`, at least one of them a label word.
    `asked` has (page, often, heads), `owned` (record, often, heads); heads are the label words of the frequent terms."""
    word = F.explode("heads").alias("word")
    own = owned.select("often", word, F.col("record").alias("id")).select("word", F.explode(F.sequence(F.lit(0), F.lit(PARTS_OF_WORD - 1))).alias("part"), F.lit(0).alias("side"), "id", "often")
    ask = asked.select("often", word, F.col("page").alias("id")).select("word", F.pmod(F.xxhash64("id"), F.lit(PARTS_OF_WORD)).cast("int").alias("part"), F.lit(1).alias("side"), "id", "often")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, records, at, bits = None, array("q"), {}, None
        for b in batches:
            out: list[tuple[int, int]] = []
            for word, part, side, number, terms in zip(*(b.column(c).to_pylist() for c in ("word", "part", "side", "id", "often"))):
                if group != (word, part):
                    group, records, at, bits = (word, part), array("q"), {}, None
                if side == 0:
                    for t in terms:
                        at.setdefault(t, array("q")).append(len(records))
                    records.append(number)
                elif records:
                    if bits is None:
                        bits, at = {t: _bits(x, len(records)) for t, x in at.items()}, {}
                    others = [(often[t][0], bits[t]) for t in terms if t != word and t in bits]
                    out += [(number, records[y]) for _, y in best_owners(others, bits[word], often[word][0])]
            zero = pa.array(np.zeros(len(out), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), zero, zero, zero], schema=PAIR)

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(ask).repartition(parts, "word", "part").sortWithinPartitions("word", "part", "side", "id").mapInArrow(search, PAIR_SQL)


def _bits(positions: array, size: int) -> int:
    flags = np.zeros(size, dtype=np.uint8)
    flags[np.frombuffer(positions, dtype=np.int64)] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


#: arrays of an index that is scanned whole, and their types
PARTS = {"record": np.int64, "keys": np.int64, "starts": np.int64, "rows": np.int32, "weights": np.float32, "labelled": np.bool_, "own": np.float64}


class Block:
    """A whole index that is scanned for one page at a time, its frequent terms as vectors: what `link` is tested against."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts
        self.total = np.zeros(len(parts["record"]), dtype=np.float32)
        self.dense: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(np.diff(parts["starts"]) >= DENSE):
            v = np.zeros(len(parts["record"]), dtype=np.float32)
            v[self.rows(k)] = parts["weights"][k]
            self.dense[int(k)] = v

    def rows(self, k: int) -> np.ndarray:
        return self.parts["rows"][self.parts["starts"][k] : self.parts["starts"][k + 1]]

    def best_two(self, terms: np.ndarray, said: int) -> list[tuple[int, float, float, float]]:
        """(record, score, parts of its label covered by the first `said` terms and by all) of the two best records that share a
        label term with the page; equal scores go to the smaller record; the parts are those of the best one only.  Distinct
        terms, in any order."""
        keys, weights, total = self.parts["keys"], self.parts["weights"], self.total
        if not len(keys) or not len(terms):
            return []
        at = np.searchsorted(keys, terms)
        hit = keys[np.minimum(at, len(keys) - 1)] == terms
        at, named = at[hit], np.flatnonzero(hit) < said
        labelled = self.parts["labelled"][at]
        if not labelled.any():
            return []
        total[:] = 0.0
        for k in at.tolist():
            if (v := self.dense.get(k)) is not None:
                total += v
            else:
                total[self.rows(k)] += weights[k]
        label = at[labelled]
        lists = [self.rows(k) for k in label]
        may = np.concatenate(lists)
        scores = total[may]
        out = []
        for _ in range(2):
            top = scores.max()
            if top < 0:
                break
            row = may[scores == top].min()
            covered = told = 0.0
            if not out:
                has = np.array([own[min(own.searchsorted(row), len(own) - 1)] == row for own in lists])
                told = float(weights[label[has]].sum())
                covered = float(weights[label[has & named[labelled]]].sum())
            whole = max(1e-9, self.parts["own"][row])
            out.append((int(self.parts["record"][row]), float(top) * (K1 + 1) / (1 + K1), min(1.0, covered / whole), min(1.0, told / whole)))
            scores[may == row] = -1.0
        return out


def link(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cache_id, row_idx, score, gap, cover, told, mutual, fits, confidence): the best record of each page that has any.

    `pages` has (cache_id, name, winery, color, grape, source, text), `catalog` (row_idx, slug, name, winery, grape, color,
    category); any of them may be NULL or empty.  Pages that share no label term with any record, and all pages for an
    empty catalog, give no row.  Equal scores go to the smaller record key, equal colours to the smaller row_idx.  Repeated
    pages give repeated results.
    """
    # copies and colours of a label are one record with the terms of all of them
    cards = cut(records(catalog).withColumn("record", F.xxhash64("label", "maker")))
    few = F.filter(F.arrays_zip("terms", "kinds"), lambda t: t["kinds"].isin("l", "m", "g"))
    owned = cut(cards.select("record", F.explode(few).alias("t")).select("record", F.col("t.terms").alias("term"), F.col("t.kinds").alias("kind")).distinct())
    total = owned.select("record").distinct().count()
    often = frequent_terms(owned, total)
    counts = mojibake.fit_bigrams(pages, ["name", "text"])
    chars = lookalike.character_counts(pages, "name")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, norm = mojibake.Bigrams(counts), lookalike.Normaliser(chars)
        schema = pa.schema([("cache_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("said", pa.int32()), ("often", pa.list_(pa.int64())), ("often_said", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64())), ("words", pa.string()), ("title", pa.string()), ("colour", pa.string())])
        for b in batches:
            out = []
            for r in b.to_pylist():
                name = lookalike.normalise(mojibake.repair(r["name"], model)[0], norm)[0] or ""
                text = mojibake.repair(r["text"], model)[0] or ""
                keys, said, e = page_terms(name, r["winery"] or "", r["color"] or "", r["grape"] or "", r["source"] or "", text)
                known = [k in often for k in keys]
                every_often = [k for k, o in zip(keys, known) if o]
                split = {"keys": [k for k, o in zip(keys, known) if not o], "said": said - sum(known[:said]), "often": every_often, "often_said": every_often[: sum(known[:said])], "heads": [k for k in every_often if often[k][1]]}
                out.append({"cache_id": r["cache_id"], **split, **e})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    source = pages.select("cache_id", "name", "winery", "color", "grape", "source", "text")
    asked = cut(source.mapInArrow(build, "cache_id long, keys array<long>, said int, often array<long>, often_said array<long>, heads array<long>, words string, title string, colour string")).withColumn("page", F.monotonically_increasing_id())

    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    label = owned.where("kind = 'l'")
    heavy = label.join(label.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("record").agg(F.sum(F.greatest(F.lit(1), F.rint(idf / UNIT).cast("long"))).alias("whole"))
    known = asked.sparkSession.createDataFrame([(t, w, w if x else 0) for t, (w, x) in often.items()], "term long, w long, label long")
    of_often = owned.join(F.broadcast(known), "term").groupBy("record").agg(F.collect_list(F.struct("term", "w", "label")).alias("terms"))
    held = cut(heavy.join(of_often, "record", "left"))

    near_pages = rare_pairs(asked, cards, often, total)
    if often:
        near_pages = near_pages.unionByName(frequent_pairs(asked, held.where("terms is not null").select("record", F.col("terms.term").alias("often"), F.filter("terms", lambda t: t["label"] > 0)["term"].alias("heads")), often))
    sums = near_pages.groupBy("page", "record").agg(*[F.sum(c).alias(c) for c in ("sum", "label", "named")])
    whole = sums.join(held, "record").join(asked.select("page", "often", "often_said"), "page")
    shared = lambda terms, c: F.aggregate(F.filter(F.coalesce("terms", F.expr("cast(array() as array<struct<term:long,w:long,label:long>>)")), lambda t: F.array_contains(terms, t["term"])), F.lit(0).cast("long"), lambda x, t: x + t[c])
    met = whole.select("page", "record", "whole", *[(F.col(a) + shared(t, c)).alias(a) for a, t, c in (("sum", "often", "w"), ("label", "often", "label"), ("named", "often_said", "label"))]).where("label > 0")
    part = lambda c: F.least(F.lit(1.0), F.col(c) / F.col("whole"))
    met = met.select("page", "record", (F.col("sum") * UNIT).alias("score"), part("named").alias("cover"), part("label").alias("told"))

    order = Window.partitionBy("page").orderBy(F.desc("score"), "record")
    two = met.withColumn("at", F.row_number().over(order)).where("at <= 2")
    first = lambda c: F.max(F.when(F.col("at") == 1, F.col(c)))
    top = two.groupBy("page").agg(first("record").alias("record"), first("score").alias("score"), first("cover").alias("cover"), first("told").alias("told"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second"))
    top = cut(top.withColumn("gap", (F.col("score") - F.coalesce("second", F.lit(0.0))) / F.col("score")))
    peak = top.groupBy("record").agg(F.max("score").alias("peak"))
    # the cards of one label by colour: a handful, the smallest row of each
    of_label = cards.groupBy("label", "maker", "colour").agg(F.min("row_idx").alias("row_idx")).groupBy("label", "maker").agg(F.sort_array(F.collect_list(F.struct("row_idx", "colour"))).alias("cards"))
    of_record = of_label.withColumn("record", F.xxhash64("label", "maker")).drop("maker").join(peak, "record")
    pairs = top.join(of_record, "record").join(asked.drop("keys", "said", "often", "often_said", "heads"), "page").withColumn("mutual", F.col("score") >= MUTUAL * F.col("peak"))
    fits = F.filter("cards", lambda c: (F.col("colour") == "") | (c["colour"] == "") | (c["colour"] == F.col("colour")))
    same = F.filter("fits", lambda c: c["colour"] == F.col("colour"))
    pairs = pairs.withColumn("fits", fits).withColumn("card", F.when(F.size(same) > 0, same[0]).when(F.size("fits") > 0, F.col("fits")[0]))
    out = cut(pairs.select("cache_id", F.coalesce(F.col("card.row_idx"), F.col("cards")[0]["row_idx"]).alias("row_idx"), "score", "gap", "cover", "told", "mutual", F.col("card").isNotNull().alias("fits"), "label", "words", "title"))
    w = _calibrated(out)
    z = sum((F.lit(float(k)) * F.expr(x) for k, x in zip(w[1:], EVIDENCE)), F.lit(float(w[0])))
    return out.select("cache_id", "row_idx", "score", "gap", "cover", "told", "mutual", "fits", (1 / (1 + F.exp(-z))).alias("confidence"))


def _calibrated(pairs: DataFrame) -> np.ndarray:
    """The curve's weights from about CALIBRATION_ROWS pairs, drawn by a hash and labelled by `same_label`."""
    rare = max(1, -(-pairs.count() // CALIBRATION_ROWS))
    drawn = pairs.where(F.pmod(F.xxhash64("cache_id"), F.lit(rare)) == 0).select(*[F.expr(x).alias(f"x{k}") for k, x in enumerate(EVIDENCE)], "label", "words", "title").collect()
    x = np.array([r[: len(EVIDENCE)] for r in drawn], dtype=float).reshape(len(drawn), len(EVIDENCE))
    return fit_curve(x, np.array([same_label(r.label, r.words, r.title) for r in drawn], dtype=float))
