"""P7: fill containers of fixed capacity with texts, never splitting a text that fits.

Minimum bin slack: a container starts with the longest text left; a bitset subset-sum dynamic program
over the multiset of remaining lengths (a capacity-wide integer whose bit s says that the sum s can be
reached) finds the sum closest to the room left, and walking the stored bitsets back gives how many
texts of each length to take.  Texts are dealt at random to windows of a bounded number of tokens,
which are packed side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarspark.plans.lineage import cut

#: tokens that one window holds on average, but room for at least so many containers
WINDOW_TOKENS, WINDOW_CONTAINERS = 1_000_000, 50
#: capacities at once, and tokens of a container (bits of the dynamic program), at most; more are refused
MAX_CAPACITIES, MAX_CAPACITY = 1_000, 1 << 22
#: containers that one window may have
CONTAINERS_A_WINDOW = 1 << 24


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many texts of each length to take so that their sum is as close to `room` as can be, never above.

    `lengths` are the distinct lengths in falling order, `counts` how many of each are left.
    """
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for size in lengths:
        if size > room or not counts[size]:
            continue
        left, take = min(counts[size], room // size), 1
        # a count is split into powers of two, so that many equal lengths cost few steps
        while left:
            take = min(take, left)
            layers.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = {}
    for size, take, before in reversed(layers):
        if not before >> best & 1:
            out[size] = out.get(size, 0) + take
            best -= size * take
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container (from 0) of each size; sizes are at most the capacity, zero sizes go to container 0."""
    place = [0] * len(sizes)
    by_size: dict[int, list[int]] = {}
    for k, s in enumerate(sizes):
        if s > 0:
            by_size.setdefault(s, []).append(k)
    counts = {s: len(v) for s, v in by_size.items()}
    lengths = sorted(counts, reverse=True)
    box = 0
    while lengths:
        top = lengths[0]
        place[by_size[top].pop()] = box
        counts[top] -= 1
        for s, n in (best_fill(lengths, counts, capacity - top) if capacity > top else {}).items():
            counts[s] -= n
            for _ in range(n):
                place[by_size[s].pop()] = box
        lengths = [s for s in lengths if counts[s]]
        box += 1
    return place


def fill_containers(sizes: DataFrame, capacities: DataFrame, id_col: str) -> DataFrame:
    """(capacity_id, capacity_tokens, container_id, id, piece_no, n_pieces, token_from, tokens): the container of every piece
    of every text, for each capacity.

    `sizes` has (id, tokens), `capacities` (capacity_id, capacity_tokens); more than MAX_CAPACITIES rows or a capacity above
    MAX_CAPACITY are refused with an error.  Every text is packed once a capacity.  A text
    larger than the capacity is cut into full pieces and a rest; a text of no tokens is one piece of 0 tokens in its window's
    first container; repeated rows are packed each for itself.  NULL sizes count as 0; capacities that are NULL or below 1
    give no rows.
    """
    id_type = dict(sizes.dtypes)[id_col]
    rows = cut(sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("row")))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    count = rows.count()
    good = capacities.where("capacity_tokens >= 1").select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens"))
    size, largest = good.agg(F.count("*"), F.max("capacity_tokens")).first()
    if size > MAX_CAPACITIES or (largest or 0) > MAX_CAPACITY:
        raise ValueError(f"{size} capacities up to {largest} tokens; at most {MAX_CAPACITIES} up to {MAX_CAPACITY} are packed")
    window_tokens = F.greatest(F.lit(WINDOW_TOKENS), F.col("capacity_tokens") * WINDOW_CONTAINERS)
    windows = F.greatest(F.lit(1), F.round(F.lit(total) / window_tokens).cast("long"), F.lit(count // 500_000))
    each = rows.crossJoin(F.broadcast(good.withColumn("windows", windows)))  # as many copies as capacities: their number is checked
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens"))).cast("int")
    each = each.withColumn("n_pieces", pieces).withColumn("window", F.pmod(F.xxhash64("row"), F.col("windows")).cast("long"))
    cap_type = dict(capacities.dtypes)["capacity_id"]

    def one_window(g: pd.DataFrame) -> pd.DataFrame:
        cap = int(g["capacity_tokens"].iloc[0])
        window = int(g["window"].iloc[0])
        ids, nos, ns, starts, toks, cap_id = [], [], [], [], [], g["capacity_id"].iloc[0]
        g = g.sort_values("row", kind="stable")
        for i, n, t in zip(g["id"], g["n_pieces"], g["tokens"]):
            for p in range(n):
                ids.append(i)
                nos.append(p + 1)
                ns.append(n)
                starts.append(p * cap)
                toks.append(min(cap, t - p * cap))
        boxes = pack(toks, cap)
        return pd.DataFrame({"capacity_id": cap_id, "capacity_tokens": cap, "container_id": [window * CONTAINERS_A_WINDOW + b for b in boxes], "id": ids, "piece_no": nos, "n_pieces": ns, "token_from": starts, "tokens": toks})

    packed = each.select("capacity_id", "capacity_tokens", "window", "row", "id", "tokens", "n_pieces").groupBy("capacity_id", "window").applyInPandas(
        one_window, f"capacity_id {cap_type}, capacity_tokens long, container_id long, id {id_type}, piece_no int, n_pieces int, token_from long, tokens long"
    )
    return packed.withColumnRenamed("id", id_col)
