"""P1: keep the main body of a page and drop the site's furniture.

The pages are kept as lines without tags, so the path of a piece of text is read from its form: root `page`, the kind of
its line (a row of links, or text), and as leaf the opening of the piece with names and figures masked.  No list of
phrases is used.  Over all pages each path gets its ratios:

* mixing: the entropy of the company a path keeps in its lines.  Sentences and data of a body are combined anew on every
  page, furniture stands alone or beside the same neighbours;
* text: length and share of lines that end like a sentence, unless the path comes back on other pages of its site;
* names: whether the names in it are those of the page (its title, address and other fields) or of other goods.

A line's score is the mean of its paths' scores weighted by length, smoothed with its neighbours' and held against a
threshold.  Lines that lost their letters take the mean score of intact lines of the same outline.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarspark.llm import mojibake
from cellarspark.llm.canonical import romanise
from cellarspark.plans.lineage import cut

#: kept when the smoothed score reaches this
THRESHOLD = 0.5
#: weight of the neighbouring lines
SMOOTHING = 0.15
#: masked characters of a piece that make its leaf
OPENING = 16
#: entropy of its company (nats) from which a path counts as fully mixed
MIXED = 1.4
#: what a path that was seen once is worth without other evidence
PRIOR = 0.3
#: share of a site's other pages that show a sentence too, from which it is the site's
SITE = 0.05
#: share of a name's letter triples found in the page's fields that make it the page's own
OWN = 0.6
#: tables of path scores up to this many rows are sent to the workers whole
SHIP_ROWS = 200_000
#: of larger tables the paths that hold at least this part of all pieces (so at most its inverse in number)
HEAVY = 1 / 4096

_LINK = re.compile(r"\s+[|·»>→•/]\s+")
_PIECE = re.compile(r"(?<=[.!?…])\s+|\s*;\s*")
_END = re.compile(r"[.!?…][»\"')\]]*$")
_HOLE = re.compile("[?�]")
_CAP = r"[A-ZА-ЯЁÀ-Þ][a-zа-яёß-ÿ]+(?:-[^\W\d_]+)*"
_NAME = re.compile(f"{_CAP}(?: {_CAP})*")
_FIGURE = re.compile(r"\d[\d.,\-–/]*")
_SITE_NAME = re.compile(r"\S+\.[a-z]{2,}\S*")
_WORD = re.compile(r"[^\W\d_]+")
LINK, LOST, END, BARE = 1, 2, 4, 8


@lru_cache(maxsize=100_000)
def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=100_000)
def _triples(word: str) -> frozenset[str]:
    w = f" {romanise(word)} "
    return frozenset(w[i : i + 3] for i in range(len(w) - 2))


@lru_cache(maxsize=100_000)
def triples(text: str) -> frozenset[str]:
    """The letter triples of the words of a text in Latin spelling."""
    return frozenset().union(*(_triples(w) for w in _WORD.findall(text)))


def leaf(piece: str, own: frozenset[str]) -> tuple[str, int, int]:
    """(leaf of a piece, characters in names that are the page's own, characters in names of others)."""
    mine = others = 0

    def mask(m: re.Match) -> str:
        nonlocal mine, others
        name = m.group()
        spaces = name.count(" ")
        if spaces >= 4:  # a row of links without signs between them
            others += len(name)
            return "^^"
        if not spaces and not m.start():
            return name
        t = triples(name)
        if t and len(t & own) >= OWN * len(t):
            mine += len(name)
        elif spaces:
            others += len(name)
        return "^"

    masked = _FIGURE.sub("#", _NAME.sub(mask, _SITE_NAME.sub("@", piece) if "." in piece else piece))
    return masked.lower().partition(":")[0][:OPENING].rstrip(), mine, others


def outline(line: str) -> str:
    """A line with its words of letters beyond ASCII (or lost ones) as signs, and its figures as others."""
    return " ".join("?" if not w.isascii() or "?" in w else w if w.isalpha() else _FIGURE.sub("#", w) for w in line.split())


def parse_page(text: str, fields: list[str | None], address: str | None, model: mojibake.Bigrams | None) -> dict[str, list[int]]:
    """Lines and pieces of a page: per line its number, flags and outline, per piece its line, path, company, length and
    characters in own and other names."""
    fixed = mojibake.repair(text, model)[0] or ""
    path = re.sub(r"^\w+://[^/]*", "", address or "")
    own = triples(" ".join([*(mojibake.repair(f, model)[0] or "" for f in fields), path.replace("-", " ")]))
    out: dict[str, list[int]] = {k: [] for k in ("no", "flags", "shape", "of", "path", "with", "size", "own", "other")}
    for no, (shown, line) in enumerate(zip(text.split("\n"), fixed.split("\n")), 1):
        if not shown.strip():
            continue
        s = " ".join(line.split())
        links = _LINK.search(s) is not None
        pieces = [x for x in (_LINK if links else _PIECE).split(s) if x]
        leaves = [(*leaf(x, own), len(x)) for x in pieces]
        keys = [_key(("link/" if links else "text/") + x[0]) for x in leaves]
        company = _key(",".join(map(str, sorted(keys))))
        bare = len(leaves) == 1 and leaves[0][0] == "^"
        at = len(out["no"])
        out["no"].append(no)
        out["flags"].append(LINK * links | LOST * (("?" in s or "\ufffd" in s) and len(_HOLE.findall(s)) > 2) | END * bool(_END.search(s)) | BARE * bare)
        out["shape"].append(_key(outline(s)))
        for k, (_, mine, others, size) in zip(keys, leaves):
            for name, v in zip(("of", "path", "with", "size", "own", "other"), (at, k, company, size, mine, others)):
                out[name].append(v)
    return out


def path_score(n: int, entropy: float, chars: int, ends: int, own: int, other: int, named: int, site: float, links: bool) -> tuple[float, float, float]:
    """(score, share of own names among names, how far the path is about other goods) from a path's sums over all pages:
    pieces, entropy of their company, characters, pieces in lines that end like sentences, characters in own and other names,
    characters of pieces with names, and the chance that another page of a page's site shows it too."""
    mixed = max(0.0, min(1.0, entropy / min(MIXED, math.log(n)))) if n > 1 else 0.0
    mixed = (mixed**1.5 * (n - 1) + PRIOR) / n
    told = min(1.0, math.log1p(chars / n) / math.log(60)) * ends / n * (1 - min(1.0, site / SITE))
    mine = (own + 0.5) / (own + other + 1)
    goods = max(0.0, 1 - 2 * mine) * crowded(own + other, named) * min(1.0, 2 * named / max(1, chars))
    return (0.0 if links else (1 - (1 - mixed) * (1 - told)) * (1 - goods)), mine, goods


def crowded(names: float, chars: float) -> float:
    """From 0 for a text with some names to 1 for a text of little else."""
    return max(0.0, min(1.0, (names / max(1, chars) - 0.3) / 0.15))


def line_scores(page: dict[str, list[int]], scores: dict[int, tuple[float, float, float]]) -> list[float]:
    """The score of every line of a page; lines without letters get theirs from their outline later."""
    pieces: list[list[int]] = [[] for _ in page["no"]]
    for j, at in enumerate(page["of"]):
        pieces[at].append(j)
    titled = any(f & BARE and page["own"][p[0]] for f, p in zip(page["flags"], pieces))
    out, listed = [], False
    for flags, mine in zip(page["flags"], pieces):
        total = max(1, sum(page["size"][j] for j in mine))
        value = about = 0.0
        for j in mine:
            size, own, other = page["size"][j], page["own"][j], page["other"][j]
            s, share, goods = scores.get(page["path"][j], (PRIOR, 0.5, 0.0))
            if not flags & LINK:
                if own:
                    s = 1 - (1 - s) * (1 - min(1.0, 1.5 * own / size) * share**0.5 * (1 - goods))
                if other:
                    s *= 1 - crowded(other, size) * (1 - share)
            value += s * size / total
            about += goods * size / total
        if flags & BARE:
            # the first bare name of a page whose fields do not tell its name is its title, unless it follows a list's label
            if listed and not page["own"][mine[0]]:
                value *= 0.3
            elif not titled:
                value, titled = 0.8, True
        elif about > 0.5:
            listed = True
        elif value > 0.5:
            listed = False
        out.append(value)
    return out


def smoothed(scores: list[float]) -> list[float]:
    """Scores fused with those of the lines before and after."""
    out = []
    for j, s in enumerate(scores):
        near = scores[max(0, j - 1) : j] + scores[j + 1 : j + 2]
        out.append((1 - SMOOTHING) * s + SMOOTHING * (sum(near) / len(near) if near else s))
    return out


def _weighted_join(df: DataFrame, table: DataFrame, key: str, ship_rows: int) -> DataFrame:
    """`df` joined with a table of distinct keys that has their weights `n`: a small table is broadcast, of a larger one only
    the keys with a HEAVY part of the weight, whose number that part bounds; no key of the rest is hot."""
    size = table.agg(F.count("*"), F.sum("n")).first()
    if size[0] <= ship_rows:
        return df.join(F.broadcast(table), key)
    heavy = F.broadcast(table.where(F.col("n") >= HEAVY * size[1]))
    rest = table.where(F.col("n") < HEAVY * size[1])
    return df.join(heavy, key).unionByName(df.join(heavy.select(key), key, "left_anti").join(rest, key))


def _path_table(parsed: DataFrame, ship_rows: int) -> DataFrame:
    """(path, n, score, share, goods) of every path; pages of the same text count once."""
    once = parsed.groupBy("text_key").agg(F.first(F.struct("host", "flags", "of", "path", "with", "size", "own", "other")).alias("p")).select("p.*")
    piece = F.explode(F.arrays_zip("path", "with", "of", "size", "own", "other")).alias("s")
    flags = F.element_at("flags", F.col("s.of") + 1)
    pieces = once.select("host", "flags", piece).where(flags.bitwiseAND(LOST) == 0)
    pieces = pieces.select("s.*", "host", flags.bitwiseAND(LINK).alias("link"), (flags.bitwiseAND(END) / END).cast("int").alias("end"))
    named = F.sum(F.when(F.col("own") + F.col("other") > 0, F.col("size")).otherwise(0)).alias("named")
    sums = [F.sum("size").alias("chars"), F.sum("end").alias("ends"), F.sum("own").alias("own"), F.sum("other").alias("other"), named, F.max("link").alias("link")]
    kept = [F.sum(c).alias(c) for c in ("chars", "ends", "own", "other", "named")]
    company = pieces.groupBy("path", "with").agg(F.count("*").alias("n"), *sums)
    paths = company.groupBy("path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), *kept, F.max("link").alias("link"))
    # pages of a site that show a path, of all its pages
    sites = once.groupBy("host").agg(F.count("*").alias("n"))
    shown = once.select("host", F.explode(F.array_distinct("path")).alias("path")).groupBy("host", "path").agg(F.count("*").alias("v"))
    chance = F.sum(F.col("v") * (F.col("v") - 1)) / (F.sum(F.col("v") * (F.col("n") - 1)) + 1)
    site = _weighted_join(shown, sites, "host", ship_rows).groupBy("path").agg(chance.alias("site"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [path_score(r["n"], math.log(r["n"]) - r["nlogn"] / r["n"], r["chars"], r["ends"], r["own"], r["other"], r["named"], r["site"], r["link"] > 0) for r in b.to_pylist()]
            cols = [pa.array([x[i] for x in rows], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["path", "n", "score", "share", "goods"])

    joined = paths.join(site, "path").select("path", "n", "nlogn", "chars", "ends", "own", "other", "named", "site", "link")
    return cut(joined.mapInArrow(rate, "path long, n long, score double, share double, goods double"))


def main_lines(pages: DataFrame, id_col: str, text_col: str, fact_cols: list[str] | None = None, address_col: str | None = None, bigrams: list[int] | None = None, ship_rows: int = SHIP_ROWS) -> DataFrame:
    """(id, line_no) of the lines that belong to the main body of each page.

    `fact_cols` are short fields that tell what the page is about, `address_col` its address; either may be left out or NULL.
    Lines are separated by U+000A and counted from 1, blank ones included.  NULL, empty and blank texts have no lines; a text
    of furniture only has none either; repeated rows give repeated results (their paths count once); other columns are ignored.
    """
    facts = list(fact_cols or [])
    counts = bigrams if bigrams is not None else mojibake.fit_bigrams(pages, [text_col, *facts])
    id_type = dict(pages.dtypes)[id_col]
    names = {"no": "int", "flags": "int", "shape": "long", "of": "int", "path": "long", "with": "long", "size": "int", "own": "int", "other": "int"}
    kinds = {"int": pa.int32(), "long": pa.int64()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mojibake.Bigrams(counts)
        for b in batches:
            fields = [b.column(2 + k).to_pylist() for k in range(len(facts) + 1)]
            parsed = [parse_page(t, list(f[:-1]), f[-1], model) for t, *f in zip(b.column(1).to_pylist(), *fields)]
            cols = [pa.array([p[n] for p in parsed], pa.list_(kinds[k])) for n, k in names.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3 + len(facts) :], *cols], names=["id", "text_key", "host", *names])

    text, address = F.col(text_col), F.col(address_col) if address_col else F.lit(None).cast("string")
    site = F.xxhash64(F.coalesce(F.regexp_extract(address, r"^\w+://([^/]*)", 1), F.lit("")))
    source = pages.where(text.isNotNull() & (F.trim(text) != "")).select(F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(facts)], address.alias("address"), F.xxhash64(text).alias("text_key"), site.alias("host"))
    fields = ", ".join(f"`{n}` array<{k}>" for n, k in names.items())
    parsed = cut(source.mapInArrow(parse, f"id {id_type}, text_key long, host long, {fields}")).withColumn("row", F.monotonically_increasing_id())
    table = _path_table(parsed, ship_rows)
    size = table.agg(F.count("*"), F.sum("n")).first()
    # the whole table if it is small, else the paths that hold a fixed part of all pieces: a bounded number either way
    least = 0.0 if size[0] <= ship_rows else HEAVY * size[1]
    shipped = {r.path: (r.score, r.share, r.goods) for r in table.where(F.col("n") >= least).collect()}
    if least:
        rare = parsed.select("row", F.explode(F.array_distinct("path")).alias("path")).join(table.where(F.col("n") < least), "path")
        found = rare.groupBy("row").agg(F.collect_list(F.struct("path", "score", "share", "goods")).alias("rare"))
        rated = parsed.join(found, "row", "left")
    else:
        rated = parsed.withColumn("rare", F.lit(None).cast("array<struct<path:long,score:double,share:double,goods:double>>"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                known = shipped if not r["rare"] else shipped | {x["path"]: (x["score"], x["share"], x["goods"]) for x in r["rare"]}
                out.append(line_scores(r, known))
            cols = [b.column(b.schema.get_field_index(c)) for c in ("row", "id", "no", "flags", "shape")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.float64()))], names=["row", "id", "no", "flags", "shape", "score"])

    scored = cut(rated.select("row", "id", *names, "rare").mapInArrow(score, f"row long, id {id_type}, no array<int>, flags array<int>, shape array<long>, score array<double>"))
    # lines that lost letters: the mean score of intact lines of the same outline
    line = scored.select("row", F.explode(F.arrays_zip("flags", "shape", "score")).alias("l")).select("row", "l.*")
    lost = line.where(F.col("flags").bitwiseAND(LOST) != 0).groupBy("shape").agg(F.count("*").alias("n"))
    intact = line.where(F.col("flags").bitwiseAND(LOST) == 0).groupBy("shape").agg(F.avg("score").alias("mean"))
    outlines = intact.join(lost, "shape")
    holes = line.where(F.col("flags").bitwiseAND(LOST) != 0).select("row", "shape").distinct()
    means = _weighted_join(holes, cut(outlines), "shape", ship_rows).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("shape", "mean"))).alias("means"))
    with_holes = F.exists("flags", lambda f: f.bitwiseAND(LOST) != 0)
    whole = scored.where(~with_holes).withColumn("means", F.lit(None).cast("map<bigint,double>"))
    final = whole.unionByName(scored.where(with_holes).join(means, "row", "left"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos = [], []
            for r in b.to_pylist():
                means = dict(r["means"] or ())
                scores = [means.get(k, s) if f & LOST else s for f, k, s in zip(r["flags"], r["shape"], r["score"])]
                for no, s in zip(r["no"], smoothed(scores)):
                    if s >= THRESHOLD:
                        ids.append(r["id"])
                        nos.append(no)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(nos, pa.int32())], names=[id_col, "line_no"])

    return final.select("id", "no", "flags", "shape", "score", "means").mapInArrow(pick, f"{id_col} {id_type}, line_no int")
