"""Operator 13, embedding whitening from a bit-sliced scatter matrix.

Entries become integers x = floor(1024 c) + 100000, and all sums that the covariance needs are exact:

1. **Shift.** The least and the largest x of each dimension are found, so that y = x - least is small and not
   negative: a dimension needs as many bit planes as its largest y has bits.
2. **Slice.** A task packs bit p of dimension j over its rows into words, one plane per (j, p). The sum of
   y_j y_k over rows is the sum of 2^(p + q) popcount(plane(j, p) AND plane(k, q)). A task keeps one number for
   each pair of dimensions, and Spark adds the tasks' numbers up in limbs of 40 bits.
3. **Centre.** n * sum(y_j y_k) - sum(y_j) sum(y_k) is n^2 times the covariance, an integer; it is only
   divided after that. ``eigh`` of this small matrix gives the components on the driver.
4. **Project.** Rows are centred, projected on the components and divided by the roots of the eigenvalues.
   The covariance of what comes out is summed up by a job of its own, as the check that the rows report.

What reaches the driver is one row per pair of dimensions, whatever the number of vectors.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped. Vectors have one
dimension; where lengths differ, the commonest length counts (of equally common ones the longest), and other
rows are dropped as if their vector were null; empty vectors have no component and so no row. A null id is
kept as it is, and repeated rows count as often as they stand there. Entries of an absolute value above 2^51
count as 2^51, so that x stays a long. Components without variance, up to rounding, have a null ``whitened``
and take no part in ``identity_error`` (null if there is no other); ``explained`` is 0 where nothing varies.
``deviation`` is null where it doesn't fit a long; ``deviation_exact`` has all its digits (null beyond 38).
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, ship

SCALE, OFFSET, MOST = 1024, 100_000, 1 << 51
COMPONENTS = 8
BLOCK_ROWS = 8_192       # rows whose planes are multiplied at a time
LIMB = 40                # bits of each of the numbers that a sum travels in
NO_VARIANCE = 1e-12      # of the largest eigenvalue: below this, an eigenvalue is rounding
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, deviation_exact decimal(38,0)")


def usable(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(vec_id, v, dims) of the rows whose vector has finite entries only."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dims"))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """x of a batch of vectors, (rows, dims) longs."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return np.floor(np.clip(flat, -MOST, MOST) * SCALE).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int) -> Iterator[np.ndarray]:
    """x in blocks of at most so many rows."""
    held: list[np.ndarray] = []
    for batch in batches:
        x = integers(batch.column(0), dims)
        for a in range(0, len(x), rows):
            held.append(x[a:a + rows])
            if sum(map(len, held)) >= rows:
                both = np.concatenate(held)
                yield both[:rows]
                held = [both[rows:]]
    if held:
        yield np.concatenate(held)


class Planes:
    """Exact sums of products of non-negative integers, from their bit planes.

    ``bits`` has the number of planes of each dimension; dimensions of no bits are 0 everywhere.
    """

    def __init__(self, bits: np.ndarray):
        self.used = np.flatnonzero(bits)
        own = bits[self.used]
        self.starts = np.cumsum(own) - own
        self.dim = np.repeat(np.arange(len(own)), own)      # of each plane, among those used
        self.bit = np.arange(len(self.dim)) - np.repeat(self.starts, own)
        # what a block adds stays below 2^63: plain longs; else Python's integers
        self.kind = np.int64 if 2 * int(own.max(initial=0)) + BLOCK_ROWS.bit_length() < 62 else object
        self.weight = np.array([1 << int(p) for p in self.bit], dtype=self.kind)
        self.sums = np.zeros(len(own), dtype=object)
        self.products = np.zeros((len(own), len(own)), dtype=object)

    def slice(self, y: np.ndarray) -> np.ndarray:
        """(planes, words): bit p of dimension j over all rows, packed; missing rows of the last word are 0."""
        words = -(-len(y) // 64)
        out = np.zeros((len(self.dim), words * 8), dtype=np.uint8)
        columns = np.ascontiguousarray(y[:, self.used].T).view(np.uint64)
        for k, (j, p) in enumerate(zip(self.dim.tolist(), self.bit.tolist(), strict=True)):
            packed = np.packbits((columns[j] >> np.uint64(p)).astype(np.uint8) & 1)
            out[k, :len(packed)] = packed
        return out.view(np.uint64)

    def add(self, y: np.ndarray) -> None:
        """Add the sums and products of a block of at most BLOCK_ROWS rows."""
        planes = self.slice(y)
        if not len(planes):
            return
        held = np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(self.kind)
        self.sums += np.add.reduceat(held * self.weight, self.starts)
        block = np.zeros(self.products.shape, dtype=self.kind)
        for k, (j, w) in enumerate(zip(self.dim.tolist(), self.weight.tolist(), strict=True)):
            first = int(self.starts[j])
            both = np.bitwise_count(planes[k] & planes[first:]).sum(axis=1, dtype=np.int64).astype(self.kind)
            block[j, j:] += np.add.reduceat(both * self.weight[first:], self.starts[j:] - first) * w
        self.products += block

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(j, k, sum of y_j y_k) with j <= k, and (j, -1, sum of y_j)."""
        for a, j in enumerate(self.used.tolist()):
            yield j, -1, int(self.sums[a])
            for b in range(a, len(self.used)):
                yield j, int(self.used[b]), int(self.products[a, b])


def _limbs(value: int) -> tuple[int, ...]:
    mask = (1 << LIMB) - 1
    return value & mask, value >> LIMB & mask, value >> 2 * LIMB & mask, value >> 3 * LIMB


def common_length(rows: DataFrame) -> int:
    """The commonest vector length, 0 if there is no vector."""
    found = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return found[0]["dims"] if found else 0


def ranges(rows: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, and the least and the largest x of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = 0, None, None
        for x in _blocks(batches, dims, BLOCK_ROWS):
            if len(x):
                n += len(x)
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(least),
                                              pa.array(most)], ["j", "n", "least", "most"])

    parts = rows.select("v").mapInArrow(run, "j long, n long, least long, most long")
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("j").collect()
    longs = lambda c: np.array([r[c] for r in found], dtype=np.int64)
    return found[0]["n"], longs("least"), longs("most")


def scatter(rows: DataFrame, least: np.ndarray, most: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of y and of products of y, y = x - least, as Python integers."""
    dims = len(least)
    bits = np.array([int(b - a).bit_length() for a, b in zip(least.tolist(), most.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(bits)
        for x in _blocks(batches, dims, BLOCK_ROWS):
            planes.add(x - least)
        found = [(j, k, *_limbs(v)) for j, k, v in planes.rows() if v]
        columns = list(zip(*found, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["j", "k", *[f"v{i}" for i in range(4)]])

    parts = rows.select("v").mapInArrow(run, "j long, k long, " + ", ".join(f"v{i} long" for i in range(4)))
    total = parts.groupBy("j", "k").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(4)])
    sums, products = [0] * dims, [[0] * dims for _ in range(dims)]
    for r in total.toLocalIterator():
        value = sum(r[f"v{i}"] << LIMB * i for i in range(4))
        if r["k"] < 0:
            sums[r["j"]] = value
        else:
            products[r["j"]][r["k"]] = products[r["k"]][r["j"]] = value
    return sums, products


class Fit(NamedTuple):
    """``components``: unit eigenvectors as columns, by falling eigenvalue; ``sums``: of y = x - least."""
    n: int
    least: np.ndarray
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def alive(self) -> np.ndarray:
        return self.values > NO_VARIANCE * max(float(self.values[0]), 0.0)


def solve(n: int, least: np.ndarray, sums: list[int], products: list[list[int]], components: int) -> Fit:
    """Centre as integers, divide, decompose. Eigenvectors have their largest entry positive."""
    centred = [[(n * v - s * t) / (n * n) for v, t in zip(row, sums, strict=True)] for row, s in zip(products, sums, strict=True)]
    cov = np.array(centred)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    top = vectors[:, order]
    sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    return Fit(n, least, sums, values[order], top * sign, float(np.trace(cov)))


def whiten(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Centred rows on the components, over the roots of the eigenvalues; nan without variance."""
    mean = np.array([s / fit.n for s in fit.sums])
    z = ((x - fit.least).astype(np.float64) - mean) @ fit.components
    return np.where(fit.alive, z / np.sqrt(np.where(fit.alive, fit.values, 1.0)), np.nan)


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """The exact sum over dimensions of (n y - sum of y)^2, which is that of (n x - sum of x)^2."""
    y, n = x - fit.least, fit.n
    widest = max(int(y.max(initial=0)), max(map(abs, fit.sums)))
    if len(fit.sums) * widest * widest < 1 << 62:
        squares, cross = (y * y).sum(axis=1), y @ np.array(fit.sums, dtype=np.int64)
    else:
        wide = y.astype(object)
        squares, cross = (wide * wide).sum(axis=1), wide @ np.array(fit.sums, dtype=object)
    last = sum(s * s for s in fit.sums)
    return [n * n * a - 2 * n * b + last for a, b in zip(squares.tolist(), cross.tolist(), strict=True)]


def identity_error(rows: DataFrame, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    kept = np.flatnonzero(fit.alive)
    if not len(kept):
        return None
    c = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c))
        for x in _blocks(batches, len(fit.least), BLOCK_ROWS):
            z = whiten(x, fit)[:, kept]
            total += np.concatenate([z.T @ z, z.sum(axis=0, keepdims=True)])
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["a", "b", "v"])

    parts = rows.select("v").mapInArrow(run, "a long, b long, v double")
    total = np.zeros((c + 1, c))
    for r in parts.groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        total[r["a"], r["b"]] = r["v"]
    mean = total[c] / fit.n
    return float(np.abs(total[:c] / fit.n - np.outer(mean, mean) - np.eye(c)).max())


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit over all usable rows (vec_id, v, dims) of one length; None without any."""
    found = rows.select("dims").limit(1).collect()
    if not found:
        return None
    n, least, most = ranges(rows, found[0]["dims"])
    sums, products = scatter(rows, least, most)
    return solve(n, least, sums, products, components)


def whitening(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id",
              components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: see SCHEMA."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, vector_col, id_col)
    dims = common_length(rows)
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    rows = cut_lineage(rows.where(F.col("dims") == dims))
    fit = fit_whitening(rows, components)
    error = identity_error(rows, fit)
    explained = np.maximum(fit.values, 0) / fit.trace if fit.trace > 0 else np.zeros(len(fit.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(fit.values)
        for batch in batches:
            x = integers(batch.column(1), dims)
            z, exact = whiten(x, fit), deviations(x, fit)
            times = lambda values: [v for v in values for _ in range(c)]
            longs = [v if v < 1 << 63 else None for v in exact]
            digits = [Decimal(v) if v < 10 ** 38 else None for v in exact]
            yield pa.RecordBatch.from_arrays([
                pa.array(times(batch.column(0).to_pylist()), pa.int64()),
                pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                pa.array(np.full(c * len(x), fit.n, dtype=np.int64)),
                pa.array(times(longs), pa.int64()),
                pa.array(z.ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(x))),
                pa.array([error] * (c * len(x)), pa.float64()),
                pa.array(times(digits), pa.decimal128(38, 0))], [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.select("vec_id", "v").mapInArrow(run, SCHEMA)
