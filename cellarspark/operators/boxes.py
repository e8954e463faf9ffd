"""Boxes of a picture: struct(x1, y1, x2, y2) columns, and arrays of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: overlap (intersection over union) from which two boxes are one
SAME = 0.35
#: a box this much narrower than the picture and than the widest box is the edge of a second thing
PART_OF_PICTURE, PART_OF_WIDEST = 0.18, 0.45
#: weight of the distance from the centre, and the part of the largest area that a better placed box must have
OFF_CENTRE, LARGE_ENOUGH = 0.35, 0.85


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def coverage(b: Column, width: int, height: int) -> Column:
    """The part of the picture that a box covers."""
    return area(b) / max(width * height, 1)


def centre(width: int, height: int, part: float = 0.72) -> tuple[int, int, int, int]:
    """The middle part of the picture's height, over its whole width."""
    tall = int(height * part)
    top = max(0, (height - tall) // 2)
    return 0, top, width, min(height, top + tall)


def pad(b: Column, width: int, height: int, part: float) -> Column:
    """A box wider by a part of the picture on every side, within the picture."""
    px, py = int(width * part), int(height * part)
    return box(F.greatest(F.lit(0), b["x1"] - px), F.greatest(F.lit(0), b["y1"] - py), F.least(F.lit(width), b["x2"] + px), F.least(F.lit(height), b["y2"] + py))


def scale(b: Column, by: float, width: int, height: int) -> Column:
    """A box scaled and cut to the picture; parts of pixels are dropped."""
    within = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), (v * by).cast("int")))
    return box(within(b["x1"], width), within(b["y1"], height), within(b["x2"], width), within(b["y2"], height))


def union(boxes: Column) -> Column:
    """The smallest box around an array of boxes; NULL for none."""
    side = lambda k, f: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, box(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max)))


def drop_parts(boxes: Column, width: int) -> Column:
    """The boxes without thin ones at the edge of something; all of them where none would be left."""
    wide = lambda b: b["x2"] - b["x1"]
    widest = F.array_max(F.transform(boxes, wide))
    kept = F.filter(boxes, lambda b: ~((wide(b) < PART_OF_PICTURE * width) & (wide(b) < widest * PART_OF_WIDEST)))
    return F.when((F.size(boxes) < 2) | (F.size(kept) == 0), boxes).otherwise(kept)


def choose(boxes: Column, width: int, height: int) -> Column:
    """The box that is large and near the centre, or the largest if that one is much smaller; the first of equal ones, NULL for none."""

    def worth(b: Column) -> Column:
        dx = ((b["x1"] + b["x2"]) / 2.0 - width / 2.0) / max(width, 1)
        dy = ((b["y1"] + b["y2"]) / 2.0 - height / 2.0) / max(height, 1)
        return F.round(area(b) * (1.0 - OFF_CENTRE * F.least(F.sqrt(dx * dx + dy * dy), F.lit(1.0))), 6)

    def first(key) -> Column:  # noqa: ANN001
        keyed = F.transform(boxes, lambda b, i: F.struct((-key(b)).alias("k"), i.alias("i"), b.alias("b")))
        return F.get(F.array_sort(keyed), F.lit(0))["b"]

    best, largest = first(worth), first(area)
    return F.when(area(best) < area(largest) * LARGE_ENOUGH, largest).otherwise(best)


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes."""
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / both if shared > 0 and both > 0 else 0.0


def merged(boxes: list[tuple]) -> list[tuple]:
    """Boxes grown by every later box that overlaps them, until none does."""
    left, out = list(boxes), []
    while left:
        grown, rest, again = left[0], left[1:], True
        while again:
            again, apart = False, []
            for b in rest:
                if overlap(grown, b) >= SAME:
                    grown, again = (min(grown[0], b[0]), min(grown[1], b[1]), max(grown[2], b[2]), max(grown[3], b[3])), True
                else:
                    apart.append(b)
            rest = apart
        out.append(grown)
        left = rest
    return out


def merge_overlaps(df: DataFrame, key: str, boxes: str) -> DataFrame:
    """(key, boxes): the boxes of each picture with overlapping ones as one; growing changes what overlaps, so it is done in
    Python, in Arrow batches.  NULL arrays count as empty."""
    kind = dict(df.dtypes)[key]
    corner = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[dict(zip(("x1", "y1", "x2", "y2"), m)) for m in merged([(x["x1"], x["y1"], x["x2"], x["y2"]) for x in row or []])] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(corner))], names=[key, "boxes"])

    return df.select(key, boxes).mapInArrow(merge, f"`{key}` {kind}, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>")
