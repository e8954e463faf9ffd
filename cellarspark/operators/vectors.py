"""Exact nearest neighbours of many query vectors at once, and vector aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: vectors in one block; a block of 64 dimensions is 2 MB
BLOCK = 4096


def _blocks(df: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """(ids, data): vectors packed into blocks of bounded size where they are, without a shuffle; NULL and empty vectors are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[list[float]] = []

        def out() -> pa.RecordBatch:
            m = np.asarray(rows, dtype=np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                rows.append(v)
                if len(ids) == block:
                    yield out()
                    ids, rows = [], []
        if ids:
            yield out()

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where((F.size("v") > 0) & F.col("id").isNotNull())
    return source.mapInArrow(pack, "ids array<long>, data binary")


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, place): the k most similar base vectors of every query vector, itself left out.

    Exact: every block of queries meets every block of the base as one matrix product, each meeting keeps k rows a query, and
    the k best of these are kept.  A zero vector has similarity 0 with all.  Equal scores go to the smaller id; a repeated id is
    one neighbour for each of its rows.
    """
    q = _blocks(queries, id_col, vec_col, block).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    b = _blocks(base, id_col, vec_col, block).select("ids", "data")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_data, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                qs = np.frombuffer(q_data).reshape(len(q_ids), -1)
                bs = np.frombuffer(data).reshape(len(ids), -1)
                if qs.shape[1] != bs.shape[1]:
                    raise ValueError(f"vectors of {qs.shape[1]} and {bs.shape[1]} dimensions do not compare")
                sims = np.round(qs @ bs.T, 6)
                own, qi = np.asarray(ids), np.asarray(q_ids)
                sims[qi[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, sims.shape), -sims), axis=1)[:, :k]
                left = np.repeat(qi, order.shape[1])
                score = np.take_along_axis(sims, order, axis=1).ravel()
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(own[order].ravel()[keep]), pa.array(score[keep])], names=["query_id", "id", "score"])

    # the pairs here are of blocks, thousands of vectors each; they are met where the blocks lie, and only k rows a query move on
    met = q.crossJoin(b).mapInArrow(meet, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mean_vectors(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(key, at, value): the mean vector of each key, position by position."""
    return df.select(key, F.posexplode(vec_col).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("value"))


def project(df: DataFrame, id_col: str, vec_col: str, head: list[list[float]]) -> DataFrame:
    """(id, vec): every vector times a matrix (a row an input), as a unit vector; a zero vector stays zero.

    One matrix product a batch, no shuffle; vectors of another size than the head's are refused, NULL and empty ones left out.
    """
    kind = dict(df.dtypes)[id_col]
    matrix = np.asarray(head, dtype=np.float64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(1).to_pylist()
            if {len(r) for r in rows} != {matrix.shape[0]}:
                raise ValueError(f"the head takes vectors of {matrix.shape[0]} numbers")
            out = np.asarray(rows, dtype=np.float64) @ matrix
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=out.copy(), where=norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[id_col, "vec"])

    return df.select(id_col, vec_col).where(F.size(vec_col) > 0).mapInArrow(multiply, f"`{id_col}` {kind}, vec array<double>")
