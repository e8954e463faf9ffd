"""P5: split a field that packs several values into one row per value.

A parsing expression grammar, tried in this order at each place:

    field   <- list / items
    list    <- '[' items ']' end                     # a bracketed list; only round the whole field
    items   <- sep* (item sep*)*
    item    <- quoted &(sep / end) / bare
    quoted  <- '"' ('""' / '\\"' / !'"' .)* '"' / '«' (!'»' .)* '»'
    bare    <- (quoted / round / comma / !sep .)+
    round   <- '(' (!')' .)* ')'
    comma   <- digit ',' digit                       # a decimal comma
    sep     <- [,;/|+&·•] / line feed / tab / blank 'и' blank / blank 'and' blank / ...

A quote or bracket that never closes matches no alternative; the parser backtracks, takes it as a bare
character and flags the value.  Closing places are indexed once per field, so a field parses in linear
time whatever its quotes do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: separators between values ----
MARKS = ",;/|+&·•\n\r\t"
WORDS = ("и", "and", "et", "und")
QUOTES = {'"': '"', "«": "»", "“": "”", "„": "“"}
# ---- end of fixed values ----

_SEP = re.compile(rf"[{re.escape(MARKS)}]|(?<=\s)(?:{'|'.join(WORDS)})(?=\s)")
_BLANK = re.compile(r"\s+")
#: where a bare value may need attention: a separator, a quote or a round bracket
_STOP = re.compile(rf"[{re.escape(MARKS)}\"«“„(]|(?<=\s)(?:{'|'.join(WORDS)})(?=\s)")


class Value(NamedTuple):
    pos: int
    part_text: str
    malformed: bool


class _Field:
    """One field with its closing places indexed."""

    def __init__(self, text: str, end: int) -> None:
        self.text, self.end = text, end
        self.closers = {q: [m.start() for m in re.finditer(re.escape(q), text[:end])] for q in {*QUOTES.values(), ")"} if q in text}

    def next_closer(self, q: str, at: int) -> int | None:
        places = self.closers.get(q, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def quoted(self, at: int) -> int | None:
        """The place after a quoted value that starts here, or None."""
        opening = self.text[at]
        closing = QUOTES.get(opening)
        if closing is None:
            return None
        k = at + 1
        while (p := self.next_closer(closing, k)) is not None:
            if opening == '"':
                if self.text[p - 1] == "\\" and p - 1 > at:
                    k = p + 1
                    continue
                if p + 1 < self.end and self.text[p + 1] == '"':
                    k = p + 2
                    continue
            return p + 1
        return None

    def round(self, at: int) -> int | None:
        p = self.next_closer(")", at + 1)
        return None if p is None else p + 1

    def at_break(self, at: int) -> bool:
        """Whether, after blanks, a separator or the end follows."""
        if m := _BLANK.match(self.text, at, self.end):
            if "\n" in m.group() or "\t" in m.group():
                return True
            at = m.end()
        return at >= self.end or _SEP.match(self.text, at, self.end) is not None


def _clean(quoted: str) -> str:
    """The content of a quoted value; an escaped quote stands for one quote."""
    body = quoted[1:-1]
    return body.replace('""', '"').replace('\\"', '"') if quoted[0] == '"' else body


def parse_values(text: str | None) -> list[Value]:
    """The values of one field in order of writing. NULL, '', 'nan' and blank fields have none; empty pieces take no position."""
    if not text or text.strip().lower() in ("", "nan"):
        return []
    start, end = 0, len(text)
    whole = text.strip()
    if whole[0] == "[" and whole[-1] == "]" and len(whole) > 1:
        start, end = text.index("[") + 1, text.rindex("]")
    field = _Field(text, end)
    out: list[Value] = []
    at = start
    dead: set[str] = set()
    while at < end:
        if m := _BLANK.match(text, at, end):
            at = m.end()
            continue
        if m := _SEP.match(text, at, end):
            at = m.end()
            continue
        after = None if text[at] in dead else field.quoted(at)
        if after is not None and field.at_break(after):
            part = _clean(text[at:after]).strip()
            if part:
                out.append(Value(len(out) + 1, part, False))
            at = after
            continue
        bad, first = False, at
        while at < end:
            m = _STOP.search(text, at, end)
            if m is None:
                at = end
                break
            at, c = m.start(), m.group()
            if c in QUOTES or c == "(":
                after = field.round(at) if c == "(" else None if c in dead else field.quoted(at)
                if after is None:
                    dead.add(c)
                    bad, at = True, at + 1
                else:
                    at = after
            elif c == "," and 0 < at < end - 1 and text[at - 1].isdigit() and text[at + 1].isdigit():
                at += 1
            else:
                break
        part = text[first:at].strip()
        if part:
            out.append(Value(len(out) + 1, part, bad))
    return out


def split_values(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, pos, n_values, part_text, malformed): one row per value of the field.

    Fields that are NULL, '', 'nan' or hold separators only give no rows; repeated rows give repeated results; columns other
    than the keys and the text are dropped, so their names may clash with the result's.  No shuffle: each row is split where it is.
    """
    types = dict(df.dtypes)
    n = len(keys)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, pos, size, part, bad = [], [], [], [], []
            for k, text in enumerate(b.column(n).to_pylist()):
                values = parse_values(text)
                for v in values:
                    take.append(k)
                    pos.append(v.pos)
                    size.append(len(values))
                    part.append(v.part_text)
                    bad.append(v.malformed)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in b.columns[:n]), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(part, pa.string()), pa.array(bad, pa.bool_())],
                names=[*keys, "pos", "n_values", "part_text", "malformed"],
            )

    fields = ", ".join(f"`{k}` {types[k]}" for k in keys)
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("__text")).where("__text is not null and __text <> ''")
    return source.mapInArrow(parse, f"{fields}, pos int, n_values int, part_text string, malformed boolean")
