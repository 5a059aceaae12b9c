"""Whitening of vectors by the principal components of their exact covariance.

Vectors become whole numbers, so sums and second moments are exact however Spark deals the rows.  The driver sees only
what has the size of the covariance matrix: its eigenvectors start in 32-bit floats and are corrected by matrix products
of higher precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Entries count up to this size, so that x has 62 bits at most.
_MOST = float(2**61)
#: Rows of one matrix product, and the bits of a limb: a sum of so many products of two limbs is an exact double.
_BLOCK, _LIMB = 4096, 20
#: Sums travel as signed digits of so many bits, which can be added for 2**23 tasks without overflow.
_DIGIT = 40
#: Corrections that are tried at most; each squares the error, so few are needed.
_STEPS = 30

_VECTOR, _SUMS = "vec_id long, x binary", "at long, digit int, value long"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and x: the components floor(1024 * c) + 100000 as one binary value of 64-bit numbers.

    Null vectors and those with a null or non-finite component are left out; components beyond 2**61 / 1024 count as that.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("x").isNotNull()).filter(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            with np.errstate(over="ignore"):
                whole = np.floor(np.clip(values * SCALE, -_MOST, _MOST)).astype(np.int64) + SHIFT
            packed = [whole[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "x"])

    return rows.mapInArrow(pack, _VECTOR).withColumn("dim", (F.length("x") / 8).cast("int"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and x-vectors, a few thousand at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(a, _BLOCK)
            raw = b"".join(part.column("x").to_pylist())
            yield part.column("vec_id"), np.frombuffer(raw, np.int64).reshape(part.num_rows, dim)


def _limbs(z: np.ndarray) -> list[np.ndarray]:
    """z as signed limbs of 20 bits, lowest first, as doubles."""
    out = []
    while True:
        low = ((z + (1 << _LIMB - 1)) & ((1 << _LIMB) - 1)) - (1 << _LIMB - 1)
        out.append(low.astype(np.float64))
        z = (z - low) >> _LIMB
        if not z.any():
            return out


def _digits(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole numbers of any size as rows (place, digit, value), zeros left out."""
    left, digit = totals.astype(object), 0
    half, mask = 1 << _DIGIT - 1, (1 << _DIGIT) - 1
    while left.any():
        low = ((left + half) & mask) - half
        at = np.flatnonzero(low)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.full(len(at), digit, np.int32)), pa.array(low[at].astype(np.int64))], names=["at", "digit", "value"])
        left, digit = (left - low) >> _DIGIT, digit + 1


def _summed(partial: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' whole numbers. Its size is that of a row or matrix of the dimensions, whatever the rows."""
    found = partial.groupBy("at", "digit").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(size, object)
    for digit, rows in found.groupby("digit"):
        total[rows["at"].to_numpy()] += rows["value"].to_numpy().astype(object) << (_DIGIT * int(digit))
    return total


def column_sums(vectors: DataFrame, dim: int) -> np.ndarray:
    """Exact sums S of each dimension."""

    def task(batches):
        total = np.zeros(dim, object)
        for _, x in _blocks(batches, dim):
            for i, limb in enumerate(_limbs(x)):
                total += limb.sum(axis=0).astype(np.int64).astype(object) << (_LIMB * i)
        yield from _digits(total)

    return _summed(vectors.select("vec_id", "x").mapInArrow(task, _SUMS), dim)


def centred_products(vectors: DataFrame, dim: int, centre: np.ndarray) -> np.ndarray:
    """Exact sums of (x - centre)(x - centre)', for a whole centre near the mean."""

    def task(batches):
        total = np.zeros((dim, dim), object)
        near: dict[int, np.ndarray] = {}
        held = 0
        for _, x in _blocks(batches, dim):
            limbs = _limbs(x - centre)
            for i, a in enumerate(limbs):
                for j, b in enumerate(limbs):
                    near[i + j] = near.get(i + j, 0) + (a.T @ b).astype(np.int64)
            held += len(limbs)
            if held >= 256:  # 64-bit sums are full soon
                total, near, held = _added(total, near), {}, 0
        yield from _digits(_added(total, near).ravel())

    return _summed(vectors.select("vec_id", "x").mapInArrow(task, _SUMS), dim * dim).reshape(dim, dim)


def _added(total: np.ndarray, near: dict[int, np.ndarray]) -> np.ndarray:
    for limb, value in near.items():
        total = total + (value.astype(object) << (_LIMB * limb))
    return total


def _long(whole: np.ndarray) -> np.ndarray:
    """Python integers as long doubles: the leading 53 bits and then the rest."""
    high = whole.astype(np.float64)
    rest = np.vectorize(lambda w, h: float(w - int(h)), otypes=[np.float64])(whole, high)
    return high.astype(np.longdouble) + rest.astype(np.longdouble)


def covariance(n: int, sums: np.ndarray, products: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """V with divisor n, rounded once: whole numbers carry everything before the division. In extended precision."""
    z = sums - n * centre  # sums of x - centre
    exact = n * products - np.outer(z, z)
    return _long(exact) / np.longdouble(n) / np.longdouble(n)


def refined_eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision.

    32-bit eigenvectors are corrected by Ogita and Aishima's iteration: with R = I - X'X and S = X'VX, each correction is a
    matrix product, and the error is squared.  Eigenvalues closer than what the iteration can tell apart form clusters: in
    each, the small matrix X'(V - mu I)X of its own vectors is solved anew, which turns them into the right ones, and the
    iteration goes on.  All products have extended precision (64 bits of mantissa).
    """
    d = len(v)
    if not d:
        return np.zeros(0, np.longdouble), np.zeros((0, 0), np.longdouble)
    scale = np.abs(v).max()
    if not scale:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    a = v / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x.astype(np.longdouble)
    last = np.inf
    for step in range(_STEPS):
        x, values, open_, change = _corrected(a, x)
        if change < 1e-18 or step > 4 and change >= last:
            break
        last = change
        for first, end in _clusters(values, open_):
            x[:, first:end] = _solved(a, x[:, first:end], values[first:end])
    x, values, _, _ = _corrected(a, x)  # what the last sub-solves, in doubles, left of non-orthogonality goes
    # A turn among close eigenvalues, which rounding leaves open, has skewed them by its square. This squares that again and turns nothing.
    for _ in range(2):
        x = x + x @ (np.eye(d, dtype=np.longdouble) - x.T @ x) / 2
    return values * scale, x / np.sqrt((x * x).sum(axis=0))


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction: vectors by falling eigenvalue, eigenvalues, how far these are open still, the largest change."""
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that what rounding adds turns the vectors and does not skew them
    values = np.diag(s) / (1 - np.diag(r))
    open_ = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= open_
    correction = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    x = x + x @ correction
    order = np.argsort(-values, kind="stable")
    return x[:, order], values[order], open_, float(np.abs(correction).max())


def _norm(m: np.ndarray) -> float:
    """The spectral norm, or a little more."""
    return float(np.linalg.norm(m.astype(np.float64), 2)) + 1e-19


def _clusters(values: np.ndarray, width: float) -> Iterator[tuple[int, int]]:
    """Runs of falling eigenvalues whose neighbours are no further apart than width."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > width) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return ((i, j) for i, j in zip(edges[:-1], edges[1:]) if j - i > 1)


def _solved(a: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cluster's vectors turned to the eigenvectors of the matrix that they span; about mu its small gaps are plain."""
    x = x / np.sqrt((x * x).sum(axis=0))
    mu = values.mean()
    small = x.T @ (a @ x - mu * x)
    size = np.abs(small).max()
    if not size:
        return x
    _, turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))
    return x @ turn[:, ::-1].astype(np.longdouble)


class Whitening:
    """What is fitted: n, sums, and up to k components. Of the size of the covariance matrix."""

    def __init__(self, n: int, sums: np.ndarray, v: np.ndarray, k: int):
        self.n, self.sums = n, sums
        values, vectors = refined_eigenvectors(v)
        self.k = min(k, len(values))
        self.values, self.vectors = values[: self.k], vectors[:, : self.k]
        total = np.trace(v) if len(v) else np.longdouble(0)
        self.explained = [float(e / total) if total > 0 else None for e in self.values]
        # Beside the largest eigenvalue, one below this is rounding: there is no variance to divide by.
        least = values[0] * len(v) * np.finfo(np.float64).eps ** 2 if len(values) else 0
        self.usable = [bool(e > least) and e > 0 for e in self.values]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """whitened (rows, k; nan where a component has no variance) and exact deviations of x-vectors."""
        top = self.n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in self.sums), default=0)
        whole = np.int64 if top < 2**63 else object
        y = self.n * x.astype(whole) - self.sums.astype(whole)
        most = int(np.abs(y).max(initial=0))
        squares = (y if most * most * max(1, x.shape[1]) < 2**63 else y.astype(object)) ** 2
        out = (y.astype(np.float64) / self.n) @ self.vectors.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / np.sqrt(self.values.astype(np.float64))
        out[:, [not u for u in self.usable]] = np.nan
        return out, squares.sum(axis=1).tolist() if x.shape[1] else [0] * len(x)


def fit(vectors: DataFrame, dim: int, n: int, k: int = 8) -> Whitening:
    """Two passes over whole_vectors() of one length: sums, then products of vectors centred near the mean. What the centre
    misses of the mean, less than 1, is taken off exactly."""
    sums = column_sums(vectors, dim)
    centre = np.array([int(Fraction(int(s), n)) for s in sums], np.int64)
    return Whitening(n, sums, covariance(n, sums, centred_products(vectors, dim, centre), centre), k)


def identity_error(white: DataFrame, n: int, usable: list[bool]) -> float | None:
    """Largest entry of the covariance of `whitened` minus the identity, over components with variance; None without any.

    Rows are centred by their measured mean before they are multiplied; each task gives one sum for each pair of components.
    """
    k = sum(usable)
    if not k:
        return None
    places = [i for i, u in enumerate(usable) if u]
    mean = np.array(white.agg(*[(F.sum(F.col("whitened")[i]) / n).alias(f"m{i}") for i in places]).first())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k), np.longdouble)
        for batch in batches:
            w = batch.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, len(usable))[:, places] - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel().astype(np.float64))], names=["at", "value"])

    sums = white.select("whitened").mapInArrow(task, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = {r["at"]: r["value"] / n for r in sums.collect()}
    return max(abs(found[i] - (i % (k + 1) == 0)) for i in range(k * k))


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component, up to k.

    A component c counts as the whole number x = floor(1024 * c) + 100000, up to 2**61.  Vectors that are null or hold a
    null or non-finite component are left out, and so are those whose length is not the most frequent one (of equally
    frequent ones the longest).  Rows with a null or repeated id are vectors like others.  Components are the unit
    eigenvectors of the covariance (divisor n), by falling eigenvalue; fewer than k where vectors are shorter.  A component
    without variance has a null `whitened` and takes no part in identity_error.  deviation is exact; null beyond 64 bits.
    Vectors without components and an empty table give no rows.

    Three passes over the whole numbers (sums, centred products, projection) and two narrow ones over the result; the only
    exchanges carry one row per task and pair of dimensions.  The driver holds matrices of the size dim * dim.
    """
    spark = vectors.sparkSession
    found = stored(whole_vectors(vectors, id_col, vector_col))
    sizes = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)
    if not dim:
        discard(found)
        return spark.createDataFrame([], RESULT)
    mine = found.filter(F.col("dim") == dim)
    model = fit(mine, dim, n, k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            white, deviations = model.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * model.k), pa.array(white.ravel(), mask=np.isnan(white).ravel()))
            exact = pa.array([d if d < 2**63 else None for d in deviations], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, exact, lists], names=["vec_id", "deviation", "whitened"])

    white = stored(mine.select("vec_id", "x").mapInArrow(task, "vec_id long, deviation long, whitened array<double>"))
    discard(found)
    error = identity_error(white, n, model.usable)
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
