"""P6: map freely written values to the entries of a reference list.

The reference entries, with their other names, transliterations and word orders as alias paths, form a
trie.  The Levenshtein automaton of the value (swapped neighbours count as one edit; its states are
bits) walks the trie and returns every entry within a distance that depends on the length.  Values with no
entry are reported as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: letters and their Latin spelling; words that a value may carry beside its name ----
ROMAN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split()))
NOTES = ("клон", "привой", "старая лоза", "дикая форма", "участок", "россия", "згу", "знмп", "импорт", "хозяйств")
LEADS = ("сорт", "сорта", "виноград", "регион", "из региона", "в", "ах", "а", "е", "ия")
#: greatest distance by length of the shorter string
REACH = ((3, 0), (5, 1), (8, 2), (99, 3))
#: a reference list above this many names is refused, as it is sent to every executor
MAX_NAMES = 200_000
# ---- end of fixed values ----


_ROMAN = {ord(k): "" if v == "-" else v for k, v in ROMAN.items()}


LENGTHS = "lengths"


def fold(text: str) -> str:
    """Small letters, ё as е, hyphens, dashes and blank runs as one blank."""
    return " ".join(re.sub(r"[^\w.%]+|_", " ", text.lower().replace("ё", "е")).split())


def romanise(text: str) -> str:
    """The usual Latin spelling of a Cyrillic name (before folding ё)."""
    return text.lower().translate(_ROMAN)


def reach(n: int) -> int:
    return next(k for upto, k in REACH if n <= upto)


class Trie:
    """Names by their letters; a node is a dict, its end holds the ref_ids under the empty key, and LENGTHS the shortest and
    longest name below."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        if len(entries) > MAX_NAMES:
            raise ValueError(f"{len(entries)} reference names; the trie is made for at most {MAX_NAMES}")
        self.root: dict = {}
        self.exact: dict[str, set[int]] = {}
        self.words: list[tuple[tuple[str, ...], int]] = []
        self.seen: dict[tuple, dict[int, int]] = {}
        for ref, name in entries:
            paths = {fold(name), fold(romanise(name)), fold(romanise(name.lower().replace("ё", "е")))}
            words = fold(name).split()
            self.words.append((tuple(words), ref))
            if 1 < len(words) <= 3:
                paths |= {" ".join(p) for p in permutations(words)}
            for p in paths:
                self.add(p, ref)

    def add(self, path: str, ref: int) -> Trie:
        """One path of an entry."""
        self.exact.setdefault(path, set()).add(ref)
        node = self.root
        for c in path:
            node = node.setdefault(c, {LENGTHS: (len(path), len(path))})
            low, high = node[LENGTHS]
            node[LENGTHS] = (min(low, len(path)), max(high, len(path)))
        node.setdefault("", set()).add(ref)
        return self

    def search(self, word: str, k: int) -> dict[int, int]:
        """Every ref within k edits of the word, with its distance.

        The word's Levenshtein automaton runs over the trie: for each number of errors e an integer holds the states reached
        (bit j: j letters of the word are read); match, insertion, replacement, deletion and swap are shifts of these. A branch
        is left when no state is alive or no entry below has a fitting length.
        """
        n, found = len(word), {}
        at: dict[str, int] = {}
        for j, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << j
        end, errors = 1 << n, range(1, k + 1)
        start = [(1 << (e + 1)) - 1 for e in range(k + 1)]
        stack = [(self.root, start, None, 0)]
        while stack:
            node, now, before, last = stack.pop()
            for c, child in node.items():
                if len(c) != 1:
                    continue
                low, high = child[LENGTHS]
                if high < n - k or low > n + k:
                    continue
                m = at.get(c, 0)
                lower = now[0]
                new = [(lower & m) << 1]
                alive = new[0]
                for e in errors:
                    own = now[e]
                    r = (own & m) << 1 | lower | lower << 1 | new[e - 1] << 1
                    if m and last and before is not None:
                        # word[j] is this letter and word[j + 1] the one before
                        r |= (before[e - 1] & m & last >> 1) << 2
                    new.append(r)
                    alive |= r
                    lower = own
                if not alive:
                    continue
                if "" in child:
                    for e in range(k + 1):
                        if new[e] & end:
                            for ref in child[""]:
                                found[ref] = min(e, found.get(ref, e))
                            break
                stack.append((child, new, now, m))
        return found

    def abbreviated(self, words: list[str]) -> set[int]:
        """Refs whose words start with the given ones, where a word that ends in a full stop may be cut after two letters."""
        out = set()
        for name, ref in self.words:
            if len(name) == len(words) and all(n == w.rstrip(".") or w.endswith(".") and len(w) > 2 and n.startswith(w[:-1]) for n, w in zip(name, words)):
                out.add(ref)
        return out


_NOTE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\"[^\"]*\"$|\d+(?:[.,]\d+)?\s*%|[;,/].*$|\s+и дикая форма.*$|\*", re.I)


def phrases(value: str) -> list[list[str]]:
    """The value's own words without notes, then runs of one to three words, longer ones first."""
    bare = fold(_NOTE.sub(" ", value)) or fold(value)
    words = [w for w in bare.split() if not re.fullmatch(r"[\d.%]+", w)]
    while len(words) > 1 and words[0] in LEADS:
        words = words[1:]
    out = [words]
    for text in dict.fromkeys((" ".join(words), fold(value))):
        ws = text.split()
        out += [ws[i : i + n] for n in (3, 2, 1) for i in range(len(ws) - n + 1)]
    return out


def lookup(trie: Trie, words: tuple[str, ...], nearest: bool) -> dict[int, int]:
    """Refs within reach of one phrase. With `nearest` the automaton is widened edit by edit and stops at the first that finds any."""
    key = (words, nearest)
    if key in trie.seen:
        return trie.seen[key]
    text = " ".join(words)
    plain = " ".join(text.replace(".", " ").split())
    if plain in trie.exact and nearest:
        hits = {r: 0 for r in trie.exact[plain]}
    elif len(plain) < 4 or plain in LEADS or plain in NOTES:
        hits = {}
    else:
        hits = {r: 0 for r in trie.abbreviated(list(words))} if "." in text else {}
        most = reach(len(plain))
        for k in range(1, most + 1) if nearest else [most]:
            if hits and nearest:
                break
            hits = {**trie.search(plain, k), **hits}
    if len(trie.seen) > 500_000:
        trie.seen.clear()
    trie.seen[key] = hits
    return hits


def candidates(value: str, trie: Trie, nearest: bool = False) -> list[tuple[int, int, int]]:
    """(ref_id, distance, letters matched) of the entries near the value, best first: all within reach, or the nearest only."""
    found: dict[int, tuple[int, int]] = {}
    for j, words in enumerate(phrases(value)):
        n = sum(map(len, words)) + len(words) - 1
        hits = lookup(trie, tuple(words), nearest) if words else {}
        for r, d in hits.items():
            if r not in found or n - 3 * d > found[r][1] - 3 * found[r][0]:
                found[r] = (d, n)
        if nearest and hits and (j == 0 or min(hits.values()) == 0):
            break
    return sorted(((r, d, n) for r, (d, n) in found.items()), key=lambda x: (3 * x[1] - x[2], x[1], x[0]))


def resolve(value: str, trie: Trie) -> tuple[int, int, int]:
    """(ref_id or 0, distance, entries tied at that distance). Two entries equally near are no answer."""
    near = candidates(value, trie, nearest=True)
    if not near:
        return 0, -1, 0
    tied = sum(x[1:] == near[0][1:] for x in near)
    return (near[0][0] if tied == 1 else 0), near[0][1], tied


def map_values(values: DataFrame, lexicon: DataFrame, keys: list[str], kind_col: str, text_col: str) -> DataFrame:
    """(keys, kind, text, ref_id, distance, n_tied, is_canonical) of every value of `values`.

    `lexicon` has (ref_id, lex_key, canonical, kind, is_alias); its size is checked before it is sent out.  ref_id is 0 for a
    value that means no entry or two equally near ones.  NULL and '' values give no rows; an empty lexicon maps everything to
    0; repeated values give the same answer; there is no shuffle.
    """
    names = lexicon.select("ref_id", "lex_key", "canonical", "kind").limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"the reference list has more than {MAX_NAMES} names")
    by_kind: dict[str, list[tuple[int, str]]] = {}
    canonical: dict[str, set[str]] = {}
    for r in names:
        by_kind.setdefault(r.kind, []).append((r.ref_id, r.lex_key))
        canonical.setdefault(r.kind, set()).add(r.canonical)
    types = dict(values.dtypes)
    n = len(keys)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {k: Trie(v) for k, v in by_kind.items()}
        empty = Trie([])

        @lru_cache(maxsize=300_000)
        def known(kind: str, text: str) -> tuple[int, int, int]:
            return resolve(text, tries.get(kind, empty))

        for b in batches:
            kinds, texts = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            got = [known(k, t) for k, t in zip(kinds, texts)]
            same = [t in canonical.get(k, ()) for k, t in zip(kinds, texts)]
            arrays = [pa.array([g[i] for g in got], pa.int64() if i == 0 else pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays, pa.array(same, pa.bool_())], names=[*keys, "kind", "text", "ref_id", "distance", "n_tied", "is_canonical"])

    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    source = values.select(*keys, F.col(kind_col).alias("kind"), F.col(text_col).alias("text")).where("text is not null and text <> '' and kind is not null")
    return source.mapInArrow(match, f"{fields}, kind string, text string, ref_id long, distance int, n_tied int, is_canonical boolean")
