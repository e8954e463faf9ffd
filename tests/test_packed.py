"""P5: the grammar on each alternative, malformed quotes, edge cases and a round trip."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellarspark.operators.packed import parse_values, split_values

CASES = [
    ("a, b", ["a", "b"]),
    ("a и b and c", ["a", "b", "c"]),
    ("a;b/c|d+e&f", list("abcdef")),
    ("• a · b\tc\nd", list("abcd")),
    ("Один 23,5%, Два", ["Один 23,5%", "Два"]),
    ("Один (клон 3, юг), Два", ["Один (клон 3, юг)", "Два"]),
    ('"a, b";"c"', ["a, b", "c"]),
    ('"a ""Старая лоза""", b', ['a "Старая лоза"', "b"]),
    ("«a и b» / c", ["a и b", "c"]),
    ('["a; b", "c"]', ["a; b", "c"]),
    ("; a;; b; ", ["a", "b"]),
    ('"одно, значение"', ["одно, значение"]),
    ("", []),
    (None, []),
    ("nan", []),
    (" , ; ", []),
    ("[]", []),
]


@pytest.mark.parametrize(("text", "parts"), CASES)
def test_values(text: str | None, parts: list[str]) -> None:
    values = parse_values(text)
    assert [v.part_text for v in values] == parts
    assert [v.pos for v in values] == list(range(1, len(parts) + 1))


def test_malformed_quotes_backtrack() -> None:
    assert [(v.part_text, v.malformed) for v in parse_values('"a, b')] == [('"a', True), ("b", False)]
    assert [(v.part_text, v.malformed) for v in parse_values("a (b, c")] == [("a (b", True), ("c", False)]


def test_long_fields_take_linear_time() -> None:
    start = time.time()
    for text in ('"' * 100_000, "(" * 100_000, 'a"b,' * 50_000, "« » " * 50_000):
        parse_values(text)
    assert time.time() - start < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_characters='\\', exclude_categories=("Cs",)), min_size=1).map(str.strip).filter(lambda x: x and x.lower() != "nan"), min_size=1, max_size=5))
def test_quoted_values_come_back(values: list[str]) -> None:
    packed = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [v.part_text for v in parse_values(packed)] == values


def test_rows(spark) -> None:
    rows = [(1, "a, b", 5), (1, "a, b", 5), (2, None, 6), (None, "c", 7), (3, "", 8)]
    df = spark.createDataFrame(rows, "row_id long, grape string, pos int")
    out = split_values(df, ["row_id"], "grape")
    assert sorted((r.row_id or 0, r.pos, r.n_values, r.part_text) for r in out.collect()) == [(0, 1, 1, "c"), (1, 1, 2, "a"), (1, 1, 2, "a"), (1, 2, 2, "b"), (1, 2, 2, "b")]
    assert split_values(df.limit(0), ["row_id"], "grape").count() == 0
