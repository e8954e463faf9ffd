"""P4: bring text that only looks the same to one form.

Code points and short strings that look alike are joined into transitive classes by union-find.
Classes whose members differ in form only (width, style, composition, blanks, hyphens, invisible
marks) are rewritten everywhere by one greedy leftmost-longest pass of a multi-pattern automaton.
Letter classes that cross scripts are rewritten inside a word, to the member that is most frequent
over all rows in the word's script.  Words made of shared letters only form classes of strings; the
spelling most frequent over all rows represents the class.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: letters of two or more scripts that look alike, one row a shape: Latin, Cyrillic, Greek ----
SHAPES = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", ""),
    ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", ""), ("T", "Т", "Τ"),
    ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Z", "", "Ζ"), ("Ë", "Ё", ""), ("a", "а", "α"), ("c", "с", "ϲ"), ("e", "е", ""),
    ("i", "і", "ι"), ("j", "ј", "ϳ"), ("k", "к", "κ"), ("o", "о", "ο"), ("p", "р", "ρ"), ("s", "ѕ", ""), ("x", "х", "χ"),
    ("y", "у", "γ"), ("ë", "ё", ""), ("v", "", "ν"), ("u", "", "υ"), ("h", "һ", ""), ("", "т", "τ"), ("", "м", "μ"),
)
HYPHENS = "‐‑⁃−﹣"
#: decompositions that change width or style only
STYLES = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<circle>")
# ---- end of fixed values ----

SCRIPTS = ("latin", "cyrillic", "greek")


class UnionFind:
    """Disjoint sets over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def script_of(c: str) -> str | None:
    """The script of a letter, None for other characters and other scripts."""
    o = ord(c)
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if c.isalpha() and (o < 0x250 or 0x1E00 <= o <= 0x1EFF):
        return "latin"
    return None


def invisible(c: str) -> bool:
    """Format characters, fillers and variation selectors: they have no look at all."""
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️"


@lru_cache(maxsize=1)
def form_classes() -> list[list[str]]:
    """Classes of strings that differ in form only; built from the Unicode data by rule."""
    uf = UnionFind()
    for o in range(0x80, 0x20000):
        c = chr(o)
        if 0xD800 <= o < 0xE000 or not unicodedata.category(c)[0] in "CLMNPSZ" or unicodedata.category(c) in ("Cn", "Co", "Cs"):
            continue
        kind = unicodedata.category(c)
        if invisible(c):
            uf.union(c, "")
        elif kind == "Zs":
            uf.union(c, " ")
        elif c in HYPHENS:
            uf.union(c, "-")
        else:
            d = unicodedata.decomposition(c)
            if d.startswith("<"):
                tag, *rest = d.split()
                if tag in STYLES or 0xFB00 <= o <= 0xFB06:
                    uf.union(c, unicodedata.normalize("NFKC", c))
            elif d and kind[0] == "L" and o < 0x2000 and unicodedata.normalize("NFC", c) == c:
                uf.union(unicodedata.normalize("NFD", c), c)
    return uf.classes()


def choose(members: list[str], counts: dict[str, int]) -> str:
    """The member of a form class that stands for it: '' for invisible marks, else the most frequent ordinary one."""
    if "" in members:
        return ""
    plain = [m for m in members if len(m) == 1 and unicodedata.normalize("NFKC", m) == m and m not in HYPHENS] or members
    ascii_first = [m for m in plain if m.isascii()]
    return max(ascii_first or plain, key=lambda m: (counts.get(m, 0), -ord(m[0])))


class Normaliser:
    """Rewrites text to one form; `counts` has the frequency of each character over all rows."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        first = set()
        for members in form_classes():
            rep = choose(members, counts)
            for m in members:
                if m and m != rep:
                    self.automaton.add_word(m, (m, rep))
                    first.update(m[-1:])
        self.automaton.make_automaton()
        uf = UnionFind()
        for row in SHAPES:
            row = [c for c in row if c]
            for c in row[1:]:
                uf.union(row[0], c)
        self.to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        for members in uf.classes():
            for script in SCRIPTS:
                own = [m for m in members if script_of(m) == script]
                if own:
                    rep = max(own, key=lambda m: (counts.get(m, 0), -ord(m)))
                    for m in members:
                        if m != rep and script_of(m) != script:
                            self.to[script][m] = rep
        self.shared = {m for row in SHAPES for m in row if m}
        self.skeleton = str.maketrans({m: next(c for c in row if c) for row in SHAPES for m in row if m})

    def forms(self, text: str) -> str:
        """One greedy automaton pass, repeated once so that marks freed from invisible neighbours compose too."""
        for _ in range(2):
            out, at = [], 0
            for end, (m, rep) in self.automaton.iter_long(text):
                start = end - len(m) + 1
                if start >= at:
                    out += (text[at:start], rep)
                    at = end + 1
            if not out:
                break
            text = "".join([*out, text[at:]])
        return text

    def word(self, word: str, around: str | None = None) -> tuple[str, str | None]:
        """(the word in its own script, that script); the script is None when every letter is shared. `around` is the script
        of the other words, for a word of mixed shared letters."""
        seen = [script_of(c) for c in word]
        sure = [s for c, s in zip(word, seen) if s and c not in self.shared]
        if len(set(filter(None, seen))) < 2:
            return word, sure[0] if sure else None
        votes = sure or [s for s in seen if s]
        if not sure and around in seen:
            votes = [around]
        # ties go to the script that is not Greek, then to the word's later letters
        script = max(SCRIPTS, key=lambda s: (votes.count(s), s != "greek", s == votes[-1]))
        table = self.to[script]
        return "".join(c if s in (script, None) else table.get(c, c) for c, s in zip(word, seen)), script


_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[ -~А-Яа-яЁё«»—–№…’“”„•·°©×€₽\n\t]*")
_MIXED = re.compile(r"[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z]")
_GREEK = re.compile("[\u0370-\u03ff]")
_SHARED = re.compile(r"(?<![^\W\d_])(?:[AaBCcEeHIiJjKkMOoPpSsTXxYyh]+|[АаВСсЕеНКкМОоРрТтХхУум]+)(?![^\W\d_])")


def normalise(text: str | None, norm: Normaliser) -> tuple[str | None, list[tuple[str, str, str]]]:
    """(the text in one form, its words of shared letters as (spelling, script, skeleton) that context leaves open)."""
    if not text:
        return text, []
    if _PLAIN.fullmatch(text) and not _MIXED.search(text):
        fixed = text
    else:
        fixed = norm.forms(text)
        if _MIXED.search(fixed) or _GREEK.search(fixed):
            sure = [s for m in _WORD.finditer(fixed) if (s := norm.word(m.group())[1])]
            around = max(SCRIPTS, key=sure.count) if sure else None
            fixed = _WORD.sub(lambda m: norm.word(m.group(), around)[0], fixed)
    unclear = []
    if _SHARED.search(fixed):
        words = [(m.group(), norm.word(m.group())[1]) for m in _WORD.finditer(fixed)]
        sure = {s for _, s in words if s}
        for k, (w, s) in enumerate(words):
            if s is None and len(w) > 1:
                own = script_of(w[0])
                after = next((x for _, x in words[k + 1 : k + 2]), None)
                if sure and sure != {own} and after != own:
                    unclear.append((w, own, w.translate(norm.skeleton).lower()))
    return fixed, unclear


def character_counts(df: DataFrame, column: str) -> dict[str, int]:
    """Frequency of every character over all rows: at most one number per code point in use, whatever the table's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            text = "".join(v for v in b.column(0).to_pylist() if v)
            for c in set(text):
                total[c] = total.get(c, 0) + text.count(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    rows = df.select(column).mapInArrow(partial, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r.c: r.n for r in rows}


def unify(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, text, fixed, changed): every text in one form.

    NULL and '' stay as they are and are unchanged; repeated rows are judged alike; columns other than the keys and the text
    are ignored.  Runs of blanks, capitals, typing errors and words wholly of another script are left alone.
    """
    counts = character_counts(df, text_col)
    fields = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    n = len(keys)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = Normaliser(counts)
        for b in batches:
            texts = b.column(n).to_pylist()
            done = [normalise(t, norm) for t in texts]
            spelling = [[w for w, _, _ in u] for _, u in done]
            skeleton = [[k for _, _, k in u] for _, u in done]
            names = [*b.schema.names[:n], "text", "fixed", "spelling", "skeleton"]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array([f for f, _ in done], pa.string()), pa.array(spelling, lists), pa.array(skeleton, lists)], names=names)

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = Normaliser(counts)
        total: dict[tuple[str, str], int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    for m in _SHARED.finditer(t):
                        w = m.group()
                        if len(w) > 1:
                            k = (w.translate(norm.skeleton).lower(), script_of(w[0]) or "")
                            total[k] = total.get(k, 0) + 1
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["skeleton", "script", "n"])

    done = df.select(*keys, text_col).mapInArrow(rewrite, f"{fields}, text string, fixed string, spelling array<string>, skeleton array<string>")
    # string classes spelled in two scripts; the most frequent spelling stands for the class
    classes = (
        df.select(text_col)
        .mapInArrow(spellings, "skeleton string, script string, n long")
        .groupBy("skeleton")
        .agg(F.sum(F.when(F.col("script") == "cyrillic", F.col("n")).otherwise(0)).alias("cyr"), F.sum(F.when(F.col("script") == "latin", F.col("n")).otherwise(0)).alias("lat"))
        .where("least(cyr, lat) > 0 and greatest(cyr, lat) >= 3 * least(cyr, lat)")
        .select("skeleton", F.when(F.col("cyr") >= F.col("lat"), "cyrillic").otherwise("latin").alias("rep"))
    )
    open_rows = done.where(F.size("spelling") > 0)
    each = open_rows.select(*keys, "text", "fixed", F.size("spelling").alias("__n"), F.explode(F.arrays_zip("spelling", "skeleton")).alias("w"))
    words = each.select(*keys, "text", "fixed", "__n", F.col("w.spelling").alias("word"), F.col("w.skeleton").alias("skeleton"))
    judged = (
        words.join(classes, "skeleton", "left")
        .groupBy(*keys, "text", "fixed", "__n")
        .agg(F.collect_set(F.when(F.col("rep").isNotNull(), F.struct("word", "rep"))).alias("swaps"), (F.count("*") / F.col("__n")).cast("int").alias("__copies"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))  # repeated rows come out as often as they came in
        .select(*keys, "text", "fixed", "swaps")
    )

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = Normaliser(counts)
        for b in batches:
            out = []
            for fixed, swaps in zip(b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()):
                for s in swaps:
                    if script_of(s["word"][0]) != s["rep"]:
                        new = "".join(norm.to[s["rep"]].get(c, c) for c in s["word"])
                        fixed = re.sub(rf"(?<![^\W\d_]){re.escape(s['word'])}(?![^\W\d_])", new, fixed)
                out.append(fixed)
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(out, pa.string())], names=[*b.schema.names[: n + 1], "fixed"])

    swapped = judged.mapInArrow(swap, f"{fields}, text string, fixed string")
    both = done.where(F.size("spelling") == 0).select(*keys, "text", "fixed").unionByName(swapped)
    return both.withColumn("changed", F.coalesce(F.col("text") != F.col("fixed"), F.lit(False)))


assert sys.maxunicode == 0x10FFFF
