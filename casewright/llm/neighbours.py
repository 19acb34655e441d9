"""Exact-bound nearest neighbours by a block matrix join of int8 product tiles.

Vectors are quantised to int8 codes with one scale each; the norm of what
rounding lost is kept. For a query x and a row y, the distance of the decoded
codes differs from the true one by at most the sum of the two lost norms
(triangle inequality), so each tile of code products gives a lower and an upper
bound for every pair. Only pairs whose lower bound does not exceed the k-th
smallest upper bound seen for the query are recomputed from the original
vectors in double precision, and heaps merge them: first over the tiles of a
task, then over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a block; a tile holds at most the square of it.
BLOCK_ROWS = 1024
#: Blocks of a group: a task joins the blocks of one group of queries with those of one group of rows.
GROUP_BLOCKS = 16
#: Sums of int8 products stay exact in float32 up to so many dimensions.
_FLOAT32_DIMS = 1024


def _blocks(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Packs usable vectors into rows of at most BLOCK_ROWS: dim, ids, float64 values, codes, scales, lost norms."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by_dim: dict[int, list] = {}
            for i, v in zip(batch["id"], batch["vector"], strict=True):
                if v is not None and len(v):
                    v = np.array([np.nan if x is None else x for x in v] if v.dtype == object else v, np.float64)
                    if np.isfinite(v).all() and v.any():
                        by_dim.setdefault(len(v), []).append((i, v))
            for dim, rows in by_dim.items():
                for start in range(0, len(rows), BLOCK_ROWS):
                    part = rows[start : start + BLOCK_ROWS]
                    values = np.stack([v for _, v in part])
                    scale = np.abs(values).max(axis=1) / 127
                    codes = np.rint(values / np.maximum(scale, np.finfo(float).tiny)[:, None]).clip(-127, 127).astype(np.int8)
                    lost = np.sqrt(((values - codes * scale[:, None]) ** 2).sum(axis=1))
                    ids = np.array([i for i, _ in part], np.int64)
                    yield pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "vectors": [values.tobytes()], "codes": [codes.tobytes()], "scales": [scale.tobytes()], "lost": [lost.tobytes()]})

    picked = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return picked.mapInPandas(pack, "dim int, ids binary, vectors binary, codes binary, scales binary, lost binary")


class _Block:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, codes: bytes, scales: bytes, lost: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim)
        self.scales, self.lost = np.frombuffer(scales, np.float64), np.frombuffer(lost, np.float64)
        whole = self.codes.astype(np.int64)
        self.norms = (whole * whole).sum(axis=1) * self.scales**2
        self.operand = self.codes.astype(np.float32 if dim <= _FLOAT32_DIMS else np.float64)


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances; squares are added in the order of the components."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        gap = x[:, i] - y[:, i]
        total += gap * gap
    return np.sqrt(total)


def tile_survivors(q: _Block, c: _Block, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that may be among the k nearest; reach holds and gets each query's smallest proven bound."""
    products = (q.operand @ c.operand.T).astype(np.float64)
    squares = q.norms[:, None] + c.norms[None, :] - 2 * products * (q.scales[:, None] * c.scales[None, :])
    middle = np.sqrt(np.maximum(squares, 0))
    slack = (q.lost[:, None] + c.lost[None, :]) * (1 + 1e-9) + 1e-6 * (np.sqrt(q.norms)[:, None] + np.sqrt(c.norms)[None, :])
    own = q.ids[:, None] == c.ids[None, :]
    upper = np.where(own, np.inf, middle + slack)
    if c.ids.size >= k:
        np.minimum(reach, np.partition(upper, k - 1, axis=1)[:, k - 1], out=reach)
    return np.nonzero(~own & (middle - slack <= reach[:, None]))


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        reach: dict[int, float] = {}
        for batch in batches:
            for t in batch.itertuples(index=False):
                q = _Block(t.dim, t.q_ids, t.q_vectors, t.q_codes, t.q_scales, t.q_lost)
                c = _Block(t.dim, t.ids, t.vectors, t.codes, t.scales, t.lost)
                bound = np.array([reach.get(i, np.inf) for i in q.ids.tolist()])
                i, j = tile_survivors(q, c, k, bound)
                reach.update(zip(q.ids.tolist(), bound.tolist(), strict=True))
                scores = exact_distances(q.vectors[i], c.vectors[j])
                for query, row, score in zip(q.ids[i].tolist(), c.ids[j].tolist(), scores.tolist(), strict=True):
                    heap = heaps.setdefault(query, [])
                    entry = (-score, -row)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        flat = [(q, -row, -score) for q, heap in heaps.items() for score, row in heap]
        yield pd.DataFrame(flat, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _merge(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(rows["score"].tolist(), rows["vec_id"].tolist(), strict=True))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [v for _, v in best], "score": [s for s, _ in best]})

    return run


def nearest(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, grid: tuple[int, int] | None = None) -> DataFrame:
    """The k nearest rows of each query by Euclidean distance: query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's own id. Ties go to the
    smaller id. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, and neither do rows with a null id;
    vectors of other dimensions are never compared. A query id that repeats is
    searched once, with its smallest vector; a row that repeats counts each
    time. Empty inputs give no rows. grid is the number of query and row
    groups: each block is sent to one line of that grid only. By default it
    grows with the tables, so that a task joins a bounded number of blocks.
    """
    q_groups, r_groups = grid or tuple(max(least, -(-df.count() // (GROUP_BLOCKS * BLOCK_ROWS))) for df, least in ((queries, 2), (rows, 16)))
    one = queries.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(vector_col).alias("vector"))
    left, right = _blocks(one, "id", "vector"), _blocks(rows, id_col, vector_col)
    cell = F.xxhash64("ids")
    left = left.select("dim", *(F.col(c).alias(f"q_{c}") for c in left.columns[1:]), F.pmod(cell, F.lit(q_groups)).cast("int").alias("qg"), F.explode(F.sequence(F.lit(0), F.lit(r_groups - 1))).alias("rg"))
    right = right.withColumn("rg", F.pmod(cell, F.lit(r_groups)).cast("int")).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    tiles = left.join(right, ["dim", "qg", "rg"])
    found = tiles.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id").applyInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")
