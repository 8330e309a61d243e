"""Whitening of embeddings by a covariance recovered from variances (polarisation).

Entries become integers, so every sum is exact.  The variance of each dimension and of each
sum of two dimensions is aggregated from squared centred values; the covariance of i and j is
half of ``var(i + j) - var(i) - var(j)``.  Only these d * (d + 1) / 2 numbers, whose count
depends on the dimension alone, reach the driver, where ``eigh`` takes the matrix apart.

* The fit list is each distinct integer vector once, made distinct before and after a shuffle
  with map-side combining: copies cost a row a task.
* Values are centred at the whole number below the mean before they are squared.  With
  u = x - floor(S/n), the squared distance from the true mean summed over the list and taken
  n times is ``n * sum(u^2) - (sum u)^2``, exactly.
* Tasks add in 64-bit integers where no sum of a block can overflow and in Python integers
  otherwise, and hand on limbs of 32 bits that Spark adds as decimals: exact at any size.

Defined cases: a null vector, or one with a null or non-finite entry, is dropped; so is a
vector whose length is not the commonest one (of equally common ones the longest); an entry
beyond a 64-bit integer after scaling takes the nearest; components without variance (a null
space, or fewer dimensions than asked for) have no rows; ``deviation`` beyond a 64-bit integer
is null; equal rows each have their rows; an empty table, or one whose rows are all equal,
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import kept
from wakeline.session import ship

SCALE = 256
COMPONENTS = 4
#: Rows of a block; a block's sums stay below 64 bits for values below ``NARROW``.
BLOCK = 2_048
NARROW = 1 << 22
LIMB_BITS = 32
#: Limbs of a block's sum: a square has at most 132 bits, and so many rows a task may have.
LIMBS = 7
#: An eigenvalue below so small a part of the largest is rounding of a null space.
LEAST_SHARE = 1e-12


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, computed in double precision."""
    return F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(value: int) -> list[int]:
    """Limbs of a whole number, the last with the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _added(vectors: DataFrame, d: int, width: int, block_sums: Callable[[np.ndarray], list[int]]) -> list[int]:
    """``width`` exact sums over all vectors of what ``block_sums`` gives for a block of rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for at in range(0, len(x), BLOCK):
                total = [t + s for t, s in zip(total, block_sums(x[at: at + BLOCK]), strict=True)]
        place = np.repeat(np.arange(width, dtype=np.int64), LIMBS)
        limb = np.tile(np.arange(LIMBS, dtype=np.int64), width)
        held = np.asarray([v for t in total for v in _limbs(t)], np.int64)
        some = held != 0
        yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(limb[some]), pa.array(held[some])], ["place", "limb", "value"])

    rows = vectors.select("x").mapInArrow(task, "place bigint, limb bigint, value bigint")
    out = [0] * width
    for r in rows.groupBy("place", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
        out[r["place"]] += int(r["value"]) << (LIMB_BITS * r["limb"])
    return out


def _column_sums(x: np.ndarray) -> list[int]:
    wide = len(x) and max(int(x.max()), -int(x.min())) >= NARROW
    return [int(s) for s in (x.astype(object) if wide else x).sum(axis=0)]


def _squares(floor: list[int]) -> Callable[[np.ndarray], list[int]]:
    """Sums of u^2 for each dimension, then of (u_i + u_j)^2 for each pair i < j."""
    def sums(x: np.ndarray) -> list[int]:
        wide = len(x) and max(abs(int(x.max())), abs(int(x.min())), *(abs(f) for f in floor)) >= NARROW
        u = x.astype(object) - np.asarray(floor, object) if wide else x - np.asarray(floor, np.int64)
        out = [int(s) for s in (u * u).sum(axis=0)]
        for i in range(u.shape[1] - 1):
            both = u[:, i:i + 1] + u[:, i + 1:]
            out += [int(s) for s in (both * both).sum(axis=0)]
        return out
    return sums


def covariance(n: int, sums: list[int], squares: list[int]) -> list[list[Fraction]]:
    """The exact covariance matrix, from variances alone.

    ``sums`` are of the centred values of each dimension; ``squares`` of each dimension and
    then of each pair, as :func:`_squares` orders them.
    """
    d = len(sums)
    spread = lambda squared, total: Fraction(n * squared - total * total, n * n)
    own = [spread(squares[i], sums[i]) for i in range(d)]
    v = [[Fraction(0)] * d for _ in range(d)]
    at = d
    for i in range(d):
        v[i][i] = own[i]
        for j in range(i + 1, d):
            v[i][j] = v[j][i] = (spread(squares[at], sums[i] + sums[j]) - own[i] - own[j]) / 2
            at += 1
    return v


class Fit:
    """Mean, eigenvalues and components of the fit list; small, a function of the dimension."""

    def __init__(self, n: int, sums: list[int], v: list[list[Fraction]], components: int):
        self.n, self.sums, self.d = n, sums, len(sums)
        values, vectors = np.linalg.eigh(np.asarray([[float(c) for c in row] for row in v]))
        values, vectors = values[::-1], vectors[:, ::-1]
        used = [k for k in range(min(components, self.d)) if values[k] > LEAST_SHARE * values[0] and values[k] > 0]
        trace = float(sum((v[i][i] for i in range(self.d)), Fraction(0)))
        self.vectors, self.values = vectors[:, used], values[used]
        self.explained = (self.values / trace).tolist() if used else []
        # x - S/n = (x - floor(S/n)) - (S mod n)/n, whose parts doubles hold well
        self.floor = [s // n for s in sums]
        self.part = np.asarray([float(Fraction(s % n, n)) for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        wide = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), *(abs(f) for f in self.floor)) >= 1 << 52
        u = (x.astype(object) - np.asarray(self.floor, object)).astype(float) if wide else (x - np.asarray(self.floor, np.int64)).astype(float)
        return u - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum over dimensions of (n * x - S)^2, exactly."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(abs(s) for s in self.sums)
        if self.d * most * most < 1 << 62:
            y = self.n * x - np.asarray(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.asarray(self.sums, object)
        return [int(s) if int(s) < 1 << 63 else None for s in (y * y).sum(axis=1)]


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``key, x`` of the rows that can be used, stored, and their dimension."""
    rows = df.filter(usable(F.col(vector))).select(F.col(key).alias("key"), whole_numbers(F.col(vector), scale).alias("x"))
    rows = kept(rows, "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("x") == d), d


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Fit | None, DataFrame]:
    """The fit on distinct vectors, None if there is nothing to fit, and the fit list."""
    listed = kept(vectors.select("x").distinct(), "fit-list")
    n = listed.count()
    if n == 0 or d == 0:
        return None, listed
    sums = _added(listed, d, d, _column_sums)
    floor = [s // n for s in sums]
    squares = _added(listed, d, d * (d + 1) // 2, _squares(floor))
    return Fit(n, sums, covariance(n, [s - n * f for s, f in zip(sums, floor, strict=True)], squares), components), listed


def identity_error(found: Fit, listed: DataFrame) -> float:
    """Largest absolute entry of the whitened list's covariance minus the identity."""
    k, d = len(found.values), found.d

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), 0
        for batch in batches:
            w = found.whitened(_matrix(batch.column("x"), d))
            total, seen = total + w.T @ w, seen + len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.reshape(-1))], ["place", "value"])

    rows = listed.mapInArrow(moments, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    v = np.zeros(k * k)
    for r in rows:
        v[r["place"]] = r["value"]
    # the whitened values are centred already: their mean is zero but for rounding
    return float(np.abs(v.reshape(k, k) / found.n - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``key, component, n, deviation, whitened, explained, identity_error``."""
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors, d = integer_vectors(df, key, vector)
    found, listed = fit(vectors, d, components)
    if found is None or len(found.values) == 0:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    error, k = identity_error(found, listed), len(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if len(x) == 0:
                continue
            row = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(row), found.n)), pa.array(found.deviation(x), pa.int64()).take(pa.array(row)),
                pa.array(found.whitened(x).reshape(-1)), pa.array(np.tile(found.explained, len(x))), pa.array(np.full(len(row), error)),
            ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, schema).withColumnRenamed("key", key)
