"""P3: find text that was decoded with a wrong character encoding and restore it.

Multi-byte damage (UTF-8 bytes shown through an 8-bit table) is handled by mapping characters
back to the bytes of the legacy table, running a UTF-8 byte-structure automaton over them, and
decoding the maximal well-formed spans only; the pass repeats while it finds spans, which undoes
double damage.  A byte-structure automaton can not see an 8-bit table read as another 8-bit table
(every byte string is well formed there), so those words are judged by a letter-bigram model
counted over all rows of the same table; README states this addition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: legacy tables and letter sets ----
READ_AS = ("cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "mac-cyrillic")
CYRILLIC_TABLES = ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
SINGLE_READ_AS = ("cp1251", "cp1252", "latin-1", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
RU = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN = "abcdefghijklmnopqrstuvwxyz"
FRENCH = "àâæçéèêëîïôœùûüÿ"
PLAIN_MARKS = " \n\t\r!\"'()*+,-./:;<=>?@[]_%&#{}|~°·«»№–—…’‘“”„•₽€$£©®™×☆★↑↓→←½¼¾±§"
ALPHABET = RU + LATIN + FRENCH  # capitals share the class of their small letter

_K = len(ALPHABET) + 6  # + outside, digit, opening and closing quotes, other signs, anything else
_OUT, _DIGIT, _OPEN, _CLOSE, _SIGN, _ELSE = range(_K - 6, _K)
_CLASS = np.full(0x10000, _ELSE, dtype=np.int32)
for _i, _c in enumerate(ALPHABET):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = _i
for _c in "0123456789":
    _CLASS[ord(_c)] = _DIGIT
for _c in PLAIN_MARKS:
    _CLASS[ord(_c)] = _OUT if _c < "\x7f" or _c in "–—…’" else _OPEN if _c in "«“„‘" else _CLOSE if _c in "»”" else _SIGN
# look-alikes, odd blanks and invisible marks are another matter (P4): they are neither for nor against garbling
for _a, _b in ((0xA0, 0xA0), (0xAD, 0xAD), (0x300, 0x3FF), (0x2000, 0x206F), (0x3000, 0x3000), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF)):
    _CLASS[_a : _b + 1] = np.where(_CLASS[_a : _b + 1] == _ELSE, _OUT, _CLASS[_a : _b + 1])
_CASE = np.zeros(0x10000, dtype=np.int8)
for _c in ALPHABET:
    _CASE[ord(_c)], _CASE[ord(_c.upper())] = 1, 2


def _byte_map(table: str) -> dict[str, int]:
    back: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            back.setdefault(bytes([b]).decode(table), b)
        except UnicodeDecodeError:
            pass
    if table in ("cp1251", "cp1252"):  # undefined bytes are shown as C1 controls by lenient readers
        for b in range(0x80, 0xA0):
            if chr(b) not in back and b not in back.values():
                back[chr(b)] = b
    return back


#: mean log-probability of a letter pair above which a word reads well
READS_WELL = -8.6
_INVERTED = re.compile("[а-яё][А-ЯЁ]")
_BACK = {t: _byte_map(t) for t in {*READ_AS, *SINGLE_READ_AS}}
_HIGH = {t: re.compile("[" + "".join(map(re.escape, m)) + "]{2,}") for t, m in _BACK.items()}
#: leads of well-formed two-, three- and four-byte sequences, and what may follow
_AUTOMATON = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+")


def _shown_sequence(back: dict[str, int]) -> re.Pattern:
    """Finds a well-formed sequence as the characters by which a table shows its bytes."""
    of = lambda a, b: "[" + "".join(re.escape(c) for c, x in back.items() if a <= x <= b) + "]"
    shapes = [((0xC2, 0xDF), (0x80, 0xBF)), ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)), ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)), ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)), ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF))]
    return re.compile("|".join("".join(of(*x) for x in s) for s in shapes if all(of(*x) != "[]" for x in s)))


_SHOWN = {t: _shown_sequence(_BACK[t]) for t in READ_AS}
#: continuation characters that also follow a letter in ordinary writing
_SOFT = set("»ё–—…’‘“”„•№\xa0" + RU.upper())
_ORDINARY = set(ALPHABET + ALPHABET.upper() + "0123456789" + PLAIN_MARKS)
_PLAUSIBLE = re.compile("[\x80-ÿŒœŸЀ-џҐґ -⁯₠-₿℀-⋿─-➿﻿�]+")
_LOST = re.compile(r"�|\?{2,}|(?<=[^\W\d_])\?(?=[^\W\d_])")
#: two or three question marks after a word are emphasis, not lost letters
_EMPHASIS = re.compile(r"(?<=[^\W\d_]{3})\?{2,3}(?=\s|$)")
_URLISH = re.compile(r"\S*(?:://|www\.)\S*")
#: something that clean text of the three languages does not show: foreign characters, inverted capitals, runs of accents
_SUSPECT = [
    re.compile(x)
    for x in (
        "[^" + re.escape("".join(sorted(_ORDINARY))) + " ​-‏⁠﻿̀-ͯ    　­！-～Ͱ-Ͽ\U0001d400-\U0001d7ff]",
        "[А-ЯЁ](?:(?<=[а-яё].)|[А-ЯЁ]{2})",
        "[à-öø-ÿÀ-ÖØ-ß]{2}",
        "[─-╿]",
        "[РС–—ÐÑГВÃÂ├┬╨╤][^\\w\\s\\d]",
        "[–—][А-Я][–—]",
    )
]
_NOT_ASCII = re.compile("[^\\x00-\\x7f]")
_SINGLE = re.compile("[^\\x00-\\x7f]{2}")
_C1 = re.compile("[\\x80-\\x84\\x86-\\x9f]")
_RUSSIAN = re.compile("[А-Яа-яЁё]")
_LETTERS = re.compile("[^\\W\\d_A-Za-z]")
_ORDINARY_RUN = re.compile("(?:[А-ЯЁ]+|[А-ЯЁ]?[а-яё]+|[^А-Яа-яЁё])*")
_LOWER = set(FRENCH + RU)
_FOREIGN = re.compile("[^" + re.escape("".join(sorted(_ORDINARY))) + "]")
_WORD = re.compile(r"[^ \t\r\n\d]+")  # a no-break blank may be a letter that was read wrongly


class Bigrams:
    """Joint log-probabilities of letter pairs, capitals as small letters; a capital after a small letter costs extra, as an
    8-bit table read as another often swaps the two."""

    def __init__(self, counts: np.ndarray) -> None:
        table = np.asarray(counts, dtype=float).reshape(_K, _K) + 0.5
        self.log = np.maximum(np.log(table / table.sum()), -14.0)
        self.log[_ELSE, :] = self.log[:, _ELSE] = -15.0
        self.log[_OUT, _OUT] = -4.0
        self.log[_SIGN, _OUT] = self.log[_OUT, _SIGN] = -6.0

    def pairs(self, line: str) -> np.ndarray:
        """Log-probability of each neighbouring pair of ` line `."""
        cps = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cps = np.minimum(cps, 0xFFFF)
        cls, case = _CLASS[cps], _CASE[cps]
        return self.log[cls[:-1], cls[1:]] - 4.0 * ((case[:-1] == 1) & (case[1:] == 2))


def count_bigrams(texts: Iterator[str]) -> np.ndarray:
    """Counts of letter pairs over an iterable of texts, as a flat array."""
    total = np.zeros(_K * _K, dtype=np.int64)
    joined = "\n".join(texts)
    if joined:
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cls = _CLASS[np.minimum(cps, 0xFFFF)]
        pair = cls[:-1].astype(np.int64) * _K + cls[1:]
        total += np.bincount(pair, minlength=_K * _K)
    return total


def fit_bigrams(df: DataFrame, columns: list[str]) -> list[int]:
    """Letter-pair counts over every row; at most K*K  numbers reach the driver, whatever the table's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_K * _K, dtype=np.int64)
        for b in batches:
            for col in b.columns:
                total += count_bigrams(v for v in col.to_pylist() if v)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    rows = df.select(*columns).mapInArrow(partial, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = [0] * (_K * _K)
    for r in rows:
        counts[r.pair] = r.n
    return counts


_AS_BYTES = {t: {ord(c): b for c, b in m.items()} for t, m in _BACK.items()}


def _decode_spans(text: str, sure: bool, first: str | None = None) -> tuple[str, int, str | None]:
    """One pass of the byte automaton under the table that explains most; returns the text, the number of sequences decoded
    and the table. Unless sure, a lone sequence that ordinary writing could show is left. `first` is tried before the others
    and is enough if it explains half of the characters beyond ASCII."""
    best, best_n, best_table = text, 0, None
    high = len(_NOT_ASCII.findall(text))
    for table in ([first] if first else []) + [t for t in READ_AS if t != first]:
        if not _SHOWN[table].search(text):
            continue
        n = shown_n = 0
        as_bytes = _AS_BYTES[table]

        def fix(m: re.Match, as_bytes: dict[int, int] = as_bytes) -> str:
            nonlocal n, shown_n
            span = m.group()
            raw = span.translate(as_bytes).encode("latin-1")
            if _AUTOMATON.search(raw) is None:
                return span
            out, at = [], 0
            for s in _AUTOMATON.finditer(raw):
                plain, shown = s.group().decode("utf-8"), span[s.start() : s.end()]
                good = _PLAUSIBLE.fullmatch(plain) is not None
                if good and not sure and len(plain) == 1:
                    good = not (shown[1] in _SOFT or (shown[0] in _LOWER and shown[1] in _ORDINARY))
                if good:
                    out += (span[at : s.start()], plain)
                    at = s.end()
                    n += len(plain)
                    shown_n += len(shown)
            out.append(span[at:])
            return "".join(out)

        fixed = _HIGH[table].sub(fix, text)
        if n > best_n:
            best, best_n, best_table = fixed, n, table
        if 4 * shown_n >= 3 * high:
            break
    return best, best_n, best_table


def _tables() -> dict[tuple[str, str], dict[int, str]]:
    pairs = {}
    for read in SINGLE_READ_AS:
        for true in CYRILLIC_TABLES:
            if read != true:
                pairs[read, true] = {ord(c): bytes([b]).decode(true, "replace") for c, b in _BACK[read].items()}
    return pairs


_RECODE = _tables()


def _follow(line: str, model: Bigrams, pair: tuple[str, str]) -> str | None:
    """A short line of a text whose other lines were read through the pair, read through it too if that reads better."""
    other = line.translate(_RECODE[pair])
    letters = _NOT_ASCII.findall(line)
    if other == line or 5 * len(_RUSSIAN.findall(other)) < 4 * len(letters) or _INVERTED.search(other):
        return None
    return other if model.pairs(other).sum() > model.pairs(line).sum() + 1.0 * len(letters) else None


def _single_byte(line: str, model: Bigrams, first: tuple[str, str] | None, margin: float = 1.6) -> tuple[str, tuple[str, str] | None]:
    """Words of one line that read far better through another pair of 8-bit tables; `first` is tried before the others."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(line)]
    high = [not line[a:b].isascii() for a, b in words]
    if not any(high):
        return line, None
    old = np.concatenate([[0.0], np.cumsum(model.pairs(line))])
    if not _INVERTED.search(line) and not _FOREIGN.search(line):
        # capitals only made the line suspect: it is clean if its longer words read well as they are
        if all(old[b + 1] - old[a] > READS_WELL * (b - a + 1) for (a, b), h in zip(words, high) if h and b - a >= 4):
            return line, None
    letters = _NOT_ASCII.findall(line)
    best_gain, best = 0.0, None
    for pair in ([first] if first else []) + [p for p in _RECODE if p != first]:
        table = _RECODE[pair]
        new_line = line.translate(table)
        if 2 * len(_RUSSIAN.findall(new_line)) < len(letters):
            continue
        new = np.concatenate([[0.0], np.cumsum(model.pairs(new_line))])
        edits, total, run, run_gain, run_len = [], 0.0, None, 0.0, 0
        for k in range(len(words) + 1):
            hit = False
            if k < len(words):
                a, b = words[k]
                gain = (new[b + 1] - new[a]) - (old[b + 1] - old[a])
                hit = high[k] and gain > 0.5 * (b - a)
            if hit:
                run = (run[0] if run else a, b)
                run_gain, run_len = run_gain + gain, run_len + b - a
            elif run and (k == len(words) or high[k] and gain < -0.5 * (b - a) or k < len(words) and not high[k] and any(c.isalpha() for c in line[a:b])):
                span, was = new_line[run[0] : run[1]], line[run[0] : run[1]]
                # a short word of ordinary letters may be an abbreviation
                if run_len >= (7 if _ORDINARY_RUN.fullmatch(was) else 4) and run_gain > margin * run_len and 5 * len(_RUSSIAN.findall(span)) >= 4 * len(_LETTERS.findall(line[run[0] : run[1]])):
                    edits.append(run)
                    total += run_gain + len(_RUSSIAN.findall(span))
                run, run_gain, run_len = None, 0.0, 0
        if edits and total > best_gain:
            best_gain, best = total, (pair, edits, new_line)
            if pair == first and total > 2.5 * sum(b - a for a, b in edits):
                break
    if best is None:
        return line, None
    pair, edits, new_line = best
    out, at = [], 0
    for a, b in edits:
        out += (line[at:a], new_line[a:b])
        at = b
    return "".join([*out, line[at:]]), pair


def _suspect(text: str) -> bool:
    return any(p.search(text) for p in _SUSPECT)


def repair(text: str | None, model: Bigrams | None) -> tuple[str | None, bool, bool]:
    """(restored text, was any part garbled, was anything lost for good). None and '' are clean."""
    if not text:
        return text, False, False
    lost = bool(("?" in text or "\ufffd" in text) and _LOST.search(text) and _LOST.search(_EMPHASIS.sub("", _URLISH.sub("", text))))
    if not lost and not _suspect(text):
        return text, False, False
    garbled, pair, table, left = lost, None, None, []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if not _suspect(line) and not (garbled and _SINGLE.search(line)):
            continue
        n_all, shown = 0, line
        for _ in range(4):
            line, n, used = _decode_spans(line, n_all > 0, table)
            if not n:
                break
            table = used
            n_all += n
        garbled |= n_all > 0
        if model is not None and 5 * n_all < len(_LETTERS.findall(shown)) and _suspect(shown):
            other, hit = _single_byte(shown, model, pair)
            if hit:
                line, pair, garbled = other, hit, True
        if line == shown:
            left.append(k)
        lines[k] = line
    if pair is not None:
        for k in left:
            if (other := _follow(lines[k], model, pair)) is not None:
                lines[k] = other
    out = "\n".join(lines)
    if _C1.search(out):
        garbled = lost = True
    return out, garbled, lost or garbled and "\ufffd" in out


def repair_fields(df: DataFrame, id_col: str, fields: list[str], bigrams: list[int] | None = None) -> DataFrame:
    """(id, field, restored, garbled, lost) of every non-missing field, one row each.

    NULL and '' fields give no rows; repeated rows give repeated results; other columns are ignored. The only shuffle is that
    of the letter-pair counts; the fields themselves are repaired where they are.
    """
    counts = bigrams if bigrams is not None else fit_bigrams(df, fields)
    id_type = dict(df.dtypes)[id_col]

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Bigrams(counts)
        for b in batches:
            at, field, out = [], [], []
            for j, name in enumerate(fields, 1):
                for k, text in enumerate(b.column(j).to_pylist()):
                    if text:
                        at.append(k)
                        field.append(name)
                        out.append(repair(text, model))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string())]
            cols += [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "field", "restored", "garbled", "lost"])

    return df.select(id_col, *fields).mapInArrow(fix, f"{id_col} {id_type}, field string, restored string, garbled boolean, lost boolean")


def without_garbled(df: DataFrame, text_col: str, bigrams: list[int], where: Column) -> DataFrame:
    """The rows of `df` but for those that meet `where` and whose text is garbled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Bigrams(bigrams)
        for b in batches:
            tested = b.column(b.num_columns - 1).to_pylist()
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([not (t and repair(x, model)[1]) for t, x in zip(tested, texts)])).select(b.schema.names[:-1])

    return df.withColumn("__tested", where).mapInArrow(keep, df.schema)
