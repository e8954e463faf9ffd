"""Products described in the data scripts of pages.  The nesting of such data has no bound, so it is walked in Python, in Arrow batches."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)
#: keys of a product's number, the first that is given counts
NUMBERS = ("gtin13", "gtin14", "gtin12", "gtin8", "gtin", "sku", "mpn")
FIELDS = ("name", "brand", "winery", "gtin", "description")


def as_text(value: object) -> str:
    """A value's text: of an object its name, of a list its first item with any."""
    while isinstance(value, dict):
        value = value.get("name")
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, list):
        return next((t for t in map(as_text, value) if t), "")
    return ""


def first_product(data: object) -> dict | None:
    """The first object of type product: an object before its graph, its graph before its other parts."""
    todo = [data]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if "product" in {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds]) if k}:
                return node
            todo.extend(reversed([v for k, v in node.items() if k != "@graph" and isinstance(v, (dict, list))]))
            graph = node.get("@graph")
            if isinstance(graph, list):
                todo.append(graph)
    return None


def product(page: str) -> dict[str, str] | None:
    """The fields of the first product that a page's data scripts describe; scripts that are no JSON are skipped."""
    for script in _SCRIPT.findall(page):
        try:
            found = first_product(json.loads(entities.unescape(script)))
        except (ValueError, RecursionError):
            continue
        if found is not None:
            number = next((t for t in (as_text(found.get(k)) for k in NUMBERS) if t), "")
            maker = found.get("manufacturer") or found.get("brand")
            return {"name": as_text(found.get("name")), "brand": as_text(found.get("brand")), "winery": as_text(maker), "gtin": re.sub(r"\D", "", number), "description": as_text(found.get("description"))}
    return None


def page_products(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, brand, winery, gtin, description) of the pages that describe a product; others give no row."""
    kind = dict(pages.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, p) for k, p in enumerate(map(product, b.column(1).to_pylist())) if p is not None]
            keys = b.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([p[f] for _, p in found], pa.string()) for f in FIELDS)], names=[key, *FIELDS])

    described = pages.select(key, html).where(F.col(html).isNotNull() & F.lower(F.col(html)).contains("ld+json"))
    return described.mapInArrow(read, f"`{key}` {kind}, " + ", ".join(f"{f} string" for f in FIELDS))
