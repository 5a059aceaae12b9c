"""Exact top-k search by inner product: tiles of queries times tiles of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Bytes of vectors in a pack (one row of the exchange), and packs of a tile at most: both bound a task's memory.
PACK_BYTES, TILE_PACKS = 4 << 20, 16
#: Lists that one merge step takes together.
FAN_IN = 16
_NONE = np.iinfo(np.int64).min

_PACK = "dim int, ids binary, keys binary, vectors binary, pack long"
_LISTS = "query_key long, query_id long, vec_id long, score long, large string, tile int"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v = floor(256 * x) of every component, as doubles.

    Rows with a null id or vector, or with a null or non-finite component, take no part.  Rows that repeat an id are
    vectors of their own.  Above 2**53 a double is whole, and 256 * x stays below infinity up to 2**1015; larger
    components count as 2**1023.
    """
    top = float(2.0**1023)
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite)
    scaled = lambda c: F.greatest(F.lit(-top), F.least(F.lit(top), c * 256))
    return rows.select(
        "vec_id", F.transform("x", lambda c: F.when(F.abs(c) < 2.0**45, F.floor(c * 256).cast("double")).otherwise(scaled(c))).alias("v")
    )


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length side by side as one binary value, ids ascending."""
    waiting: dict[int, list[tuple]] = {}

    def full(dim: int) -> pa.RecordBatch:
        ids, keys, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
        order = np.argsort(ids, kind="stable")
        if np.abs(vectors).max(initial=0) < 2**31:
            vectors = vectors.astype(np.int32)
        columns = [[dim], *([x[order].tobytes()] for x in (ids, keys, vectors))]
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["dim", "ids", "keys", "vectors"])

    for batch in batches:
        ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
        lists = batch.column(2)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(ends)
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            vectors = values[ends[mine][:, None] + np.arange(dim)]
            most = max(1, PACK_BYTES // (8 * max(1, dim)))
            for a in range(0, len(mine), most):
                part = mine[a : a + most]
                waiting.setdefault(dim, []).append((ids[part], keys[part], vectors[a : a + most]))
                if sum(len(w[0]) for w in waiting[dim]) >= most:
                    yield full(dim)
    for dim in list(waiting):
        yield full(dim)


def _packed(vectors: DataFrame, key) -> DataFrame:
    rows = vectors.select("vec_id", key.alias("key"), "v").mapInArrow(_packs, _PACK.rpartition(",")[0])
    return stored(rows.withColumn("pack", F.monotonically_increasing_id()))


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) + 1) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)  # every partial sum is an exact double
    return q.astype(np.int64) @ c.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k highest scores of each row, ties to the smaller id; ids ascend. Scores of int64 minimum are none."""
    rows, n = scores.shape
    if n > k:
        # The k-th highest score is a threshold; ties at it go to the first columns.
        kth = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above = scores > kth
        tied = scores == kth
        take = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        cols = np.nonzero(take)[1].reshape(rows, k)
    else:
        cols = np.broadcast_to(np.arange(n), (rows, n))
    top = np.take_along_axis(scores, cols, axis=1)
    order = np.argsort(-top, axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1), ids[np.take_along_axis(cols, order, axis=1)]


class _Pack:
    """The vectors of a pack. large: rows whose products may exceed 64 bits."""

    def __init__(self, row):
        self.dim = int(row.dim)
        self.ids, self.keys = (np.frombuffer(x, np.int64) for x in (row.ids, row.keys))
        narrow = len(row.vectors) == 4 * len(self.ids) * self.dim
        self.v = np.frombuffer(row.vectors, np.int32 if narrow else np.float64).reshape(len(self.ids), self.dim).astype(np.float64)
        size = np.abs(self.v).max(axis=1, initial=0)
        self.large = size >= np.sqrt(2.0**62 / max(1, self.dim))
        self.plain = ~self.large

    def whole(self, mask: np.ndarray) -> list[list[int]]:
        return [[int(x) for x in row] for row in self.v[mask]]


def _exact(q: _Pack, asked: np.ndarray, c: _Pack, among: np.ndarray, k: int) -> Iterator[tuple]:
    """The same with whole numbers of any size, for the few rows that need them."""
    candidates = list(zip(c.ids[among].tolist(), c.whole(among)))
    if not candidates:
        return
    for i, key, x in zip(q.ids[asked].tolist(), q.keys[asked].tolist(), q.whole(asked)):
        scores = ((sum(a * b for a, b in zip(x, y)), j) for j, y in candidates if j != i)
        for s, j in sorted(scores, key=lambda found: (-found[0], found[1]))[:k]:
            yield key, i, j, str(s)


def _tile(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_key", "query_id", "vec_id", "score", "large"]
        parts, large = [], []
        candidates = [_Pack(row) for row in right.itertuples(index=False)]
        for q in map(_Pack, left.itertuples(index=False)):
            asked = np.flatnonzero(q.plain)
            for a in range(0, len(asked), 256):
                block = asked[a : a + 256]
                scores, ids = [], []
                for c in candidates:
                    own = c.ids[c.plain]
                    if c.dim == q.dim and len(own):
                        s = _product(q.v[block], c.v[c.plain])
                        s[q.ids[block, None] == own[None, :]] = _NONE
                        top, best = _best(s, own, k)
                        scores.append(top)
                        ids.append(best)
                if not scores:
                    continue
                s, j = np.concatenate(scores, axis=1), np.concatenate(ids, axis=1)
                order = np.argsort(j, axis=1, kind="stable")
                s, j = np.take_along_axis(s, order, axis=1), np.take_along_axis(j, order, axis=1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, j = np.take_along_axis(s, order, axis=1), np.take_along_axis(j, order, axis=1)
                keep = s.ravel() != _NONE
                repeated = [np.repeat(x[block], s.shape[1])[keep] for x in (q.keys, q.ids)]
                parts.append(pd.DataFrame(dict(zip(names, (*repeated, j.ravel()[keep], s.ravel()[keep])))))
            for c in candidates:
                if c.dim == q.dim:
                    large += _exact(q, q.large, c, c.large | c.plain, k)
                    large += _exact(q, q.plain, c, c.large, k)
        if large:
            parts.append(pd.DataFrame(large, columns=["query_key", "query_id", "vec_id", "large"]).astype({"large": object}))
        out = pd.concat(parts) if parts else pd.DataFrame(columns=names)
        out = out.reindex(columns=names).astype({n: "Int64" for n in names[:4]} | {"large": object})
        out["large"] = np.array([x if isinstance(x, str) else None for x in out["large"]], object)
        return out.assign(tile=int(right["tile"].iloc[0]) if len(right) else 0)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates (all, if fewer).

    Both inputs come from quantised().  A candidate with the query's own id is left out; all other rows are candidates,
    those that repeat an id and vector too.  A query that is repeated whole is asked once; vectors under one id that
    differ are queries of their own.  Vectors of different lengths are not compared; ties go to the smaller vec_id.  No
    queries or no candidates give no rows.

    Vectors are packed as they are read, without a shuffle.  Every (query tile, candidate tile) is one task's matrix
    products, which keeps k rows per query; lists then merge as a tree of FAN_IN, so no task sees all tiles.  A tile is
    TILE_PACKS packs of PACK_BYTES, so vectors travel once for every 64 MB of the other side.  Where products could
    exceed 64 bits, whole numbers of any size are compared; a score beyond 64 bits is reported as the largest or
    smallest long, in its right place.
    """
    q = queries.select("vec_id", "v", F.xxhash64("v").alias("key")).dropDuplicates(["vec_id", "key"])
    q, c = _packed(q, F.col("key")), _packed(candidates, F.lit(0).cast("long"))
    n_q, n_c = q.count(), c.count()
    tasks = 2 * q.sparkSession.sparkContext.defaultParallelism
    q_tiles = max(1, -(-n_q // TILE_PACKS))
    c_tiles = max(1, -(-n_c // TILE_PACKS), min(n_c, -(-tasks // q_tiles)))
    tile = lambda n: F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.drop("pack").withColumn("q_tile", F.pmod(F.xxhash64("ids"), F.lit(q_tiles)).cast("int")).withColumn("tile", every(c_tiles))
    right = c.withColumn("tile", tile(c_tiles)).drop("pack").withColumn("q_tile", every(q_tiles))
    lists = left.groupBy("q_tile", "tile").cogroup(right.groupBy("q_tile", "tile")).applyInPandas(_tile(k), _LISTS)
    lists = stored(lists)
    discard(q, c)
    # Decimals hold 38 digits; longer numbers go by sign, length and digits.
    digits = F.ltrim(F.col("large"), F.lit("-"))
    sign = F.when(F.length(digits) > 38, F.when(F.col("large").startswith("-"), -1).otherwise(1)).otherwise(0)
    size = F.when(sign == 0, F.coalesce(F.col("large"), F.col("score").cast("string"))).cast("decimal(38,0)")
    lists = lists.withColumns({"sign": sign, "size": size, "digits": F.when(sign != 0, digits)})
    upward = F.when(F.col("sign") > 0, F.col("digits"))
    falling = [F.desc("sign"), F.desc("size"), F.desc(F.length("digits") * F.col("sign")), upward.desc(), F.asc("digits")]
    while True:
        c_tiles = -(-c_tiles // FAN_IN)
        lists = lists.withColumn("tile", F.expr(f"tile div {FAN_IN}").cast("int"))
        w = Window.partitionBy("query_id", "query_key", "tile").orderBy(*falling, "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if c_tiles <= 1:
            ends = [F.lit(x).cast("decimal(38,0)") for x in (-(2**63), 2**63 - 1)]
            within = F.when(F.col("sign") < 0, ends[0]).when(F.col("sign") > 0, ends[1]).otherwise(F.greatest(ends[0], F.least(ends[1], "size")))
            score = F.coalesce("score", within.cast("long"))
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
