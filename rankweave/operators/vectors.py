"""Kernels of the exact top-k (E6): what a task does with dense or sparse vectors.

Both kinds offer the same operations on blocks of rows:

* ``home``    the group that a vector belongs to
* ``extent``  numbers of a group that bound its scores from above, joined by elementwise maximum
* ``bounds``  an upper bound of the scores of every query with every group
* ``topk``    the best ``k`` rows of a group for each query, among those that reach a floor
* ``kth``     the k-th best score of a group for each query
* ``above``   what of a group reaches a floor, for ``Best`` to choose from

Scores are inner products rounded to 6 decimals, and equal scores go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_ROWS = 1_024   # items scored at a time against a block of queries
FOLD = 1_024         # columns that a sparse group's extent has; places beyond fold onto them
SPARSE_ROW_BYTES = 2_048
SLACK = 2e-6         # above the rounding of scores and the error of bounds

Found = tuple[np.ndarray, np.ndarray, np.ndarray]   # (query, row of x, score), one row for each answer


def _flat(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all values)."""
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    return lengths, pc.list_flatten(col).to_numpy(zero_copy_only=False)


class Dense:
    """``array<double>`` vectors; groups lie round pivots."""

    @staticmethod
    def read(col) -> np.ndarray:
        lengths, flat = _lists(_flat(col))
        if len(lengths) == 0:
            return np.zeros((0, 0))
        if lengths.min() != lengths.max():
            raise ValueError("vectors must all have the same dimension")
        return flat.astype(np.float64, copy=False).reshape(len(lengths), int(lengths[0]))

    @staticmethod
    def row_bytes(x: np.ndarray) -> int:
        """Of a row, about."""
        return 8 * x.shape[1] + 16

    @staticmethod
    def join(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts)

    @staticmethod
    def take(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return x[rows]

    @staticmethod
    def same_space(a: np.ndarray, b: np.ndarray) -> None:
        if a.shape[1] != b.shape[1]:
            raise ValueError("queries and items must have vectors of the same dimension")

    @staticmethod
    def home(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """The nearest pivot."""
        return (x @ pivots.T - (pivots * pivots).sum(axis=1) / 2).argmax(axis=1)

    @staticmethod
    def extent(x: np.ndarray, home: np.ndarray, pivots: np.ndarray) -> dict[int, np.ndarray]:
        """Radius of each group."""
        away = np.sqrt(((x - pivots[home]) ** 2).sum(axis=1))
        return {int(g): away[home == g].max(keepdims=True) for g in np.unique(home)}

    @staticmethod
    def bounds(q: np.ndarray, pivots: np.ndarray, extents: np.ndarray) -> np.ndarray:
        """q.x = q.p + q.(x - p) <= q.p + |q| radius."""
        return q @ pivots.T + np.sqrt((q * q).sum(axis=1))[:, None] * extents[:, 0] + SLACK

    @staticmethod
    def topk(q: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray, chunk: int = CHUNK_ROWS):
        """(scores, rows of x), both (queries, k), best first; scores of -inf fill up what is missing.

        Rows of x must be in order of their ids. They are visited a chunk at a time, so a task holds
        queries x (k + chunk) scores. A stable sort leaves the smaller id in front of an equal score, and a later
        row only matters if it beats the current k-th score.
        """
        best = np.full((len(q), k), -np.inf)
        place = np.zeros((len(q), k), dtype=np.int64)
        for a in range(0, len(x), chunk):
            scores = np.round(q @ x[a:a + chunk].T, 6)
            hit = (scores > best[:, -1:]) & (scores >= floor[:, None])
            rows = np.flatnonzero(hit.any(axis=1))
            if not len(rows):
                continue
            both = np.concatenate([best[rows], np.where(hit[rows], scores[rows], -np.inf)], axis=1)
            where = np.concatenate([place[rows], np.broadcast_to(np.arange(a, a + scores.shape[1]), (len(rows), scores.shape[1]))], axis=1)
            first = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best[rows], place[rows] = np.take_along_axis(both, first, 1), np.take_along_axis(where, first, 1)
        return best, place

    @staticmethod
    def kth(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query; x has at least k rows."""
        return np.partition(np.round(q @ x.T, 6), len(x) - k, axis=1)[:, len(x) - k]

    @staticmethod
    def above(q: np.ndarray, x: np.ndarray, k: int, floor: Callable[[], np.ndarray], chunk: int = CHUNK_ROWS) -> Iterator[Found]:
        """(query, row of x, score) of all scores that reach the floor of the moment, a chunk of rows at a time; may be more than k a query.

        Products in single precision, with the bound of their error, tell which pairs may reach it; these are scored in double precision.
        """
        most = np.sqrt(max((q * q).sum(axis=1).max(initial=0), 0) * max((x * x).sum(axis=1).max(initial=0), 0))
        single = bool(most < 1e30)   # false for what isn't finite, too
        slack = SLACK + (most * (q.shape[1] + 4) * 2.0 ** -23 + q.shape[1] * 1e-37 if single else 0.0)
        left = q.astype(np.float32) if single else q
        for a in range(0, len(x), chunk):
            part = x[a:a + chunk]
            raw, least = left @ part.astype(left.dtype, copy=False).T, floor()
            low = (least - slack).astype(left.dtype)
            if single:
                low = np.nextafter(low, np.float32(-np.inf))
            flat = np.flatnonzero(raw >= low[:, None])
            row, at = np.divmod(flat, raw.shape[1])
            scores = np.round(np.einsum("ij,ij->i", q[row], part[at]) if single else raw.ravel()[flat], 6)
            reached = scores >= least[row]
            yield row[reached], a + at[reached], scores[reached]


class Csr(NamedTuple):
    """Rows of (place, weight), one after the other."""
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))


class Sparse:
    """``struct<places: array<int>, weights: array<double>>`` vectors with distinct places and weights >= 0.

    A group is searched by posting lists. The lists of a query that together can't reach the floor are left
    for the end: a row that only they hold can't be an answer.
    """

    @staticmethod
    def read(col) -> Csr:
        col = _flat(col)
        lengths, places = _lists(col.field("places"))
        weights = _lists(col.field("weights"))[1].astype(np.float64, copy=False)
        if len(weights) and weights.min() < 0:
            raise ValueError("sparse vectors must have weights of at least 0")
        starts = np.concatenate([[0], np.cumsum(np.nan_to_num(lengths).astype(np.int64))])
        return Csr(starts, places.astype(np.int64, copy=False), weights)

    @staticmethod
    def row_bytes(x: Csr) -> int:
        """Of a row, about: so many that a slab of posting lists has no more rows than a group part."""
        return max(16 + 12 * int(x.starts[-1] // max(1, len(x))), SPARSE_ROW_BYTES)

    @staticmethod
    def join(parts: list[Csr]) -> Csr:
        return Csr(np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.starts) for p in parts]))]),
                   np.concatenate([p.places for p in parts]), np.concatenate([p.weights for p in parts]))

    @staticmethod
    def take(x: Csr, rows: np.ndarray) -> Csr:
        sizes = np.diff(x.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes) + np.repeat(x.starts[rows], sizes)
        return Csr(starts, x.places[at], x.weights[at])

    @staticmethod
    def same_space(a: Csr, b: Csr) -> None:
        """Places of one embedder; nothing to compare."""

    @staticmethod
    def home(x: Csr, pivots: Csr) -> np.ndarray:
        """By the place of the largest weight (the first of equal ones); rows without a place are in group 0."""
        out = np.zeros(len(x), dtype=np.int64)
        order = np.lexsort((x.places, -x.weights, x.row))
        full = np.flatnonzero(np.diff(x.starts))
        out[full] = x.places[order][x.starts[full]] % len(pivots)
        return out

    @staticmethod
    def extent(x: Csr, home: np.ndarray, pivots: Csr) -> dict[int, np.ndarray]:
        """The largest weight of each (folded) place in each group."""
        groups, at = np.unique(home, return_inverse=True)
        most = np.zeros((len(groups), FOLD))
        np.maximum.at(most, (at[x.row], x.places % FOLD), x.weights)
        return dict(zip(groups.tolist(), most, strict=True))

    @staticmethod
    def bounds(q: Csr, pivots: Csr, extents: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(q), FOLD))
        np.add.at(wide, (q.row, q.places % FOLD), q.weights)
        return wide @ extents.T + SLACK

    @staticmethod
    def topk(q: Csr, x: Csr, k: int, floor: np.ndarray, chunk: int = CHUNK_ROWS):
        order = np.argsort(x.places, kind="stable")
        held, first = np.unique(x.places[order], return_index=True)
        ends = np.append(first[1:], len(order))
        rows, weights = x.row[order], x.weights[order]
        most = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0)
        place_of = np.searchsorted(held, x.places)
        best, place = np.full((len(q), k), -np.inf), np.zeros((len(q), k), dtype=np.int64)
        for j in range(len(q)):
            places, w = q.places[q.starts[j]:q.starts[j + 1]], q.weights[q.starts[j]:q.starts[j + 1]]
            at = np.searchsorted(held, places)
            known = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == places) if len(held) else np.zeros(len(places), bool)
            at, w = at[known], w[known]
            least = floor[j] - SLACK
            if least > 0:
                reach = w * most[at]
                light_first = np.argsort(reach, kind="stable")
                upto = np.cumsum(reach[light_first])
                light = upto < least           # lists that can't reach the floor together
                if light.all():
                    continue
                acc, rest = np.zeros(len(x)), float(upto[light][-1]) if light.any() else 0.0
                for i in light_first[~light].tolist():
                    a, b = first[at[i]], ends[at[i]]
                    acc[rows[a:b]] += w[i] * weights[a:b]
                some = np.flatnonzero(acc + rest >= least)
            else:
                acc = np.zeros(len(x))
                for i in range(len(at)):
                    a, b = first[at[i]], ends[at[i]]
                    acc[rows[a:b]] += w[i] * weights[a:b]
                kth = np.partition(acc, len(acc) - k)[len(acc) - k] if len(acc) > k else 0.0
                if kth > SLACK:
                    some = np.flatnonzero(acc >= kth - SLACK)
                else:  # of the rows without a common place, those with the smallest ids
                    some = np.sort(np.concatenate([np.flatnonzero(acc > 0), np.flatnonzero(acc == 0)[:k]]))
            if not len(some):
                continue
            asked = np.zeros(len(held))
            asked[at] = w
            part = Sparse.take(Csr(x.starts, place_of, x.weights), some)
            scores = np.round(np.bincount(part.row, part.weights * asked[part.places], len(some)), 6)
            reached = scores >= floor[j]
            some, scores = some[reached], scores[reached]
            top = np.argsort(-scores, kind="stable")[:k]
            best[j, :len(top)], place[j, :len(top)] = scores[top], some[top]
        return best, place

    @staticmethod
    def kth(q: Csr, x: Csr, k: int) -> np.ndarray:
        """The k-th best score of each query; x has at least k rows."""
        return Sparse.topk(q, x, k, np.full(len(q), -np.inf))[0][:, -1]

    @staticmethod
    def above(q: Csr, x: Csr, k: int, floor: Callable[[], np.ndarray]) -> Iterator[Found]:
        """(query, row of x, score) of the best k of each query that reach the floor."""
        best, place = Sparse.topk(q, x, k, floor())
        row, rank = np.nonzero(best > -np.inf)
        yield row, place[row, rank], best[row, rank]


class Best:
    """The best ``k`` (id, score) of each query so far; rows that don't reach its k-th score are dropped now and then.

    What is held is ``k`` rows a query, and as many that came since, but for one chunk.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray, ids: np.ndarray):
        self.k, self.floor, self.ids, self.most = k, floor.copy(), ids, max(1, n * k)
        self.kept: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[Found] = []
        self.n_new = 0

    def add(self, found: Found) -> None:
        self.new.append(found)
        self.n_new += len(found[0])
        if self.n_new >= self.most:
            self.cut()

    def cut(self) -> None:
        """Raises the floors to the k-th scores and drops what lies below, in no order; rows that fill up with equal scores are sorted."""
        row, place, score = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        n = len(self.floor)
        held = np.bincount(row, minlength=n)
        wide = int(held.max())
        if wide <= self.k:
            self.kept, self.new, self.n_new = (row, place, score), [], 0
            return
        if n * wide > 4 * len(row):   # a few queries hold most of the rows
            self.settle()
            return
        order = np.argsort(row.astype(np.uint16) if n <= 1 << 16 else row, kind="stable")
        row, place, score = row[order], place[order], score[order]
        table = np.full((n, wide), -np.inf)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)] = score
        self.floor = np.maximum(self.floor, np.partition(table, wide - self.k, axis=1)[:, wide - self.k])
        inside = score >= self.floor[row]
        row, place, score = row[inside], place[inside], score[inside]
        equal = (np.bincount(row, minlength=n) > self.k)[row]
        self.kept, self.new, self.n_new = (row[~equal], place[~equal], score[~equal]), [], 0
        if equal.any():
            best = self._first(row[equal], place[equal], score[equal])
            self.kept = tuple(np.concatenate(x) for x in zip(self.kept, best, strict=True))

    def _first(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> Found:
        """The best k of each query in order of query, falling score and rising id."""
        order = np.lexsort((self.ids[place], -score, row))
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        inside = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < self.k
        return row[inside], place[order][inside], score[order][inside]

    def settle(self) -> Found:
        """(query, place, score) in order of query, falling score and rising id."""
        self.kept = row, _, score = self._first(*(np.concatenate(x) for x in zip(self.kept, *self.new, strict=True)))
        held = np.bincount(row, minlength=len(self.floor))
        full = np.flatnonzero(held >= self.k)
        last = (np.cumsum(held) - held)[full] + self.k - 1
        self.floor[full] = np.maximum(self.floor[full], score[last])
        self.new, self.n_new = [], 0
        return self.kept


def kernel_of(data_type) -> type:
    """The kernel for a vector column's type."""
    return Sparse if data_type.typeName() == "struct" else Dense
