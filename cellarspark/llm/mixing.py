"""P8: draw texts by source so that each source has its target share of the tokens.

Every text of a source is used floor(r) times, where r is the tokens wanted over the tokens there are,
and once more with probability r - floor(r).  The extra uses are drawn by the cube method: in each block
the probabilities are moved within the null space of the balancing constraints (number of texts, tokens)
until at most two of them are undecided; what the blocks leave undecided is balanced again, and the last
few of a source are landed where the token total is closest.  A text so long that its whole-or-nothing
alone would miss the share is placed first, by carrying the rounding error from one to the next, and the
rate of the others makes up for it.
"""

from __future__ import annotations

import random
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarspark.plans.lineage import cut

#: texts that one block of the flight holds on average
BLOCK = 50_000
#: a text above this part of its source's wanted tokens is placed before the flight; no more than LONG_TEXTS of a source are
LONG_PART, LONG_TEXTS = 0.01, 1_000
#: sources with a target, at most; more are refused
MAX_SOURCES = 1_000
EPS = 1e-9


def flight(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Probabilities moved to 0 or 1 but for at most two, keeping their sum and the sum of prob x size.

    Three undecided texts at a time: their direction in the null space of (1, size) is the cross product of the two rows.
    """
    p = list(prob)
    open_ = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if max(map(abs, u)) < EPS:
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(open_, u) if abs(x) > EPS)
            down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(open_, u) if abs(x) > EPS)
            step = up if rng.random() * (up + down) < down else -down
            for i, x in zip(open_, u):
                p[i] = min(1.0, max(0.0, p[i] + step * x))
            open_ = [i for i in open_ if EPS < p[i] < 1 - EPS]
    return [round(x) if not EPS < x < 1 - EPS else x for x in p]


def land(prob: list[float], size: list[float]) -> list[int]:
    """The last undecided texts set to 0 or 1 where the token total comes closest to what was left."""
    todo = [k for k, x in enumerate(prob) if EPS < x < 1 - EPS]
    want = sum(prob[k] * size[k] for k in todo)
    pick = min(product((0, 1), repeat=len(todo)), key=lambda c: (abs(sum(x * size[k] for x, k in zip(c, todo)) - want), c))
    out = [round(x) for x in prob]
    for k, x in zip(todo, pick):
        out[k] = x
    return out


def _plan(texts: DataFrame, targets: DataFrame, total_tokens: float | None) -> dict[str, tuple[float, int, int]]:
    """source -> (uses wanted per text, at most, texts); the total is the largest at which every share can be met, if not given."""
    goals = targets.select("source", "target_share", "max_repeat").limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    wanted = {r.source: (r.target_share, r.max_repeat) for r in goals if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeat or 0) > 0}
    have = {r.source: (r.tokens, r.n) for r in texts.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()} if wanted else {}
    if not have:
        return {}
    top = min(m * have[s][0] / t if s in have else 0.0 for s, (t, m) in wanted.items())
    if top == 0:  # a source without texts: the others keep their proportions
        top = min(m * have[s][0] / t for s, (t, m) in wanted.items() if s in have)
    total = top if total_tokens is None else total_tokens
    return {s: (min(wanted[s][0] * total / tok, float(wanted[s][1])), wanted[s][1], n) for s, (tok, n) in have.items()}


def place_long(sizes: list[int], rate: float, most: int) -> list[int]:
    """Uses of the long texts of a source, longest first: the rounding error of each is carried to the next."""
    carry, out = 0.0, []
    for size in sizes:
        carry += rate * size
        n = min(most, max(0, round(carry / size)))
        carry -= n * size
        out.append(n)
    return out


def draw(texts: DataFrame, targets: DataFrame, id_col: str, total_tokens: float | None = None, seed: int = 17) -> DataFrame:
    """(id, source, tokens, uses) of the texts drawn, each used at least once and at most max_repeat times.

    `texts` has (id, source, tokens), `targets` (source, target_share, max_repeat), a small table read by the driver.  Texts of
    no tokens, with a NULL source or one without a target are not drawn; repeated rows are drawn each for itself; equal sizes
    and empty tables are no special case.  With `total_tokens` above what the caps allow, a source gives all it may.
    """
    id_type = dict(texts.dtypes)[id_col]
    rows = cut(texts.where("source is not null and tokens > 0").select(F.col(id_col).alias("id"), "source", F.col("tokens").cast("long").alias("tokens"), F.monotonically_increasing_id().alias("row")))
    plan = _plan(rows, targets, total_tokens)
    if not plan:
        return rows.select(F.col("id").alias(id_col), "source", "tokens", F.lit(0).alias("uses")).limit(0)
    spark = rows.sparkSession
    have = {r.source: r.tokens for r in rows.where(F.col("source").isin(*plan)).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    limit = {s: max(LONG_PART * r * have[s], have[s] / LONG_TEXTS) for s, (r, _, _) in plan.items()}
    limits = F.broadcast(spark.createDataFrame(list(limit.items()), "source string, long_from double"))
    sided = rows.join(limits, "source")
    # texts above a part of the source's tokens: at most LONG_TEXTS of each of at most MAX_SOURCES sources
    longs: dict[str, list] = {}
    for x in sorted(sided.where("tokens > long_from").collect(), key=lambda x: (-x.tokens, x.row)):
        longs.setdefault(x.source, []).append(x)
    placed, rates = [], {}
    for s, (rate, most, _) in plan.items():
        took = place_long([x.tokens for x in longs.get(s, [])], rate, most)
        placed += [(x.id, s, x.tokens, n) for x, n in zip(longs.get(s, []), took) if n]
        left = have[s] - sum(x.tokens for x in longs.get(s, []))
        wanted = rate * have[s] - sum(x.tokens * n for x, n in zip(longs.get(s, []), took))
        rates[s] = min(float(most), max(0.0, wanted / left)) if left else 0.0
    long_rows = spark.createDataFrame(placed, f"{id_col} {id_type}, source string, tokens long, uses int")
    per = spark.createDataFrame([(s, rates[s], int(rates[s] + EPS), max(1, n // BLOCK)) for s, (_, _, n) in plan.items()], "source string, rate double, base int, blocks int")
    units = sided.where("tokens <= long_from").join(F.broadcast(per), "source").withColumn("prob", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    units = units.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    schema = f"source string, block int, row long, id {id_type}, tokens long, base int, prob double"

    def fly(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "row"], ascending=[False, True], kind="stable")  # short texts last: they are what stays undecided
        rng = random.Random(f"{seed}/{g['source'].iloc[0]}/{g['block'].iloc[0]}")
        return g.assign(prob=flight(g["prob"].tolist(), g["tokens"].astype(float).tolist(), rng))

    cols = ["source", "block", "row", "id", "tokens", "base", "prob"]
    moved = cut(units.select(*cols).groupBy("source", "block").applyInPandas(fly, schema))
    undecided = F.col("prob").between(EPS, 1 - EPS)
    settled, rest = moved.where(~undecided), moved.where(undecided)
    # each block leaves two texts at most, so a round shrinks them by a factor of BLOCK / 2 until one block a source is left
    blocks = max(max(1, n // BLOCK) for _, _, n in plan.values())
    while 2 * blocks > BLOCK:
        blocks = -(-2 * blocks // BLOCK)
        again = cut(rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).groupBy("source", "block").applyInPandas(fly, schema))
        settled, rest = settled.unionByName(again.where(~undecided)), again.where(undecided)

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "row"], ascending=[False, True], kind="stable")  # short texts last: they are what stays undecided
        size = g["tokens"].astype(float).tolist()
        p = flight(g["prob"].tolist(), size, random.Random(f"{seed}/{g['source'].iloc[0]}"))
        return g.assign(prob=[float(x) for x in land(p, size)])

    landed = rest.groupBy("source").applyInPandas(finish, schema)
    uses = (F.col("base") + F.round("prob").cast("int")).alias("uses")
    return settled.unionByName(landed).select(F.col("id").alias(id_col), "source", "tokens", uses).where("uses > 0").unionByName(long_rows)


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeat, texts, most_uses, tokens_drawn, actual_share): what the draw really reached."""
    got = drawn.groupBy("source").agg(F.count("*").alias("texts"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_drawn"))
    total = got.agg(F.sum("tokens_drawn").alias("all_tokens"))
    return (
        targets.join(got, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select("source", "target_share", "max_repeat", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"), F.coalesce(F.col("tokens_drawn") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
