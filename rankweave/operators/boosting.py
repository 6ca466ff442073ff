"""Second-order boosted trees for G3-G5, with histograms from Spark.

Features are put into equal-width bins between their least and largest values. For each tree, and each of its
levels, one job sums the gradients and hessians of the logistic loss by (node, feature, bin); the driver
sees these sums only, and picks for each node the split with the largest regularised gain

    G_L^2 / (H_L + lambda) + G_R^2 / (H_R + lambda) - G^2 / (H + lambda).

Gradients are rounded to multiples of a power of two that is so large that sums of them are exact. So sums don't
depend on partitions or their order, and neither do the trees. Being exact, the sums of a node are those of its parent
less those of its sibling, so a level visits the lighter children only, and leaves need no visit.

The rows stand in lots, one row of the table for some 2^16 of them, dealt over all cores; the margins and gradients of the next tree
are made on the first visit for it and kept (``persist``), and the margins are written to the shared folder every ``KEPT_TREES``
trees. A table of at most ``local_rows`` rows is grown in one task in the same way; a test holds both
against each other.

Rows and columns are sampled for each tree by fixed rules on the row's hash and the tree's number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written

BINS = 64
LOCAL_ROWS = 1 << 18
LOT_ROWS = 1 << 16      # rows of a lot at most
PART_ROWS = 1 << 21     # rows of a partition, about, if there are more of them than TASKS_PER_CORE asks for
TASKS_PER_CORE = 2
KEPT_TREES = 40         # trees after which margins are written


class Params(NamedTuple):
    """The settings of the original model, and its library's regularisation."""
    trees: int = 200
    depth: int = 6
    eta: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    l2: float = 1.0
    least_hessian: float = 1.0


class Tree(NamedTuple):
    """Nodes by heap number (children of i are 2i + 1 and 2i + 2); feature -1: a leaf. Rows with a bin above ``bin`` go right."""
    feature: list[int]
    bin: list[int]
    value: list[float]
    gain: list[float]

    def leaf(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node in which each row ends, at most ``depth`` levels down."""
        feature, cut = np.array(self.feature), np.array(self.bin)
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = feature[node]
            inner = f >= 0
            right = bins[rows, np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node


class Booster(NamedTuple):
    features: list[str]
    low: list[float]
    high: list[float]
    trees: list[Tree]
    params: Params

    def to_json(self) -> str:
        return json.dumps(self)

    @staticmethod
    def from_json(text: str) -> Booster:
        features, low, high, trees, params = json.loads(text)
        return Booster(features, low, high, [Tree(*t) for t in trees], Params(*params))

    def bins(self, x: np.ndarray) -> np.ndarray:
        low, span = np.array(self.low), np.array(self.high) - np.array(self.low)
        place = np.floor((x - low) / np.where(span > 0, span, 1.0) * BINS)
        return np.clip(place, 0, BINS - 1).astype(np.int16)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees:
            out += np.array(t.value)[t.leaf(bins, self.params.depth)]
        return out

    def probability(self, df: DataFrame, columns: list[str]) -> Column:
        """P(positive) of rows whose features are these columns."""
        ship_package(df.sparkSession)
        sent = df.sparkSession.sparkContext.broadcast(self)  # trees of a fixed number and depth

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for series in batches:
                x = np.stack([c.to_numpy(dtype=float) for c in series], axis=1)
                yield pd.Series(1 / (1 + np.exp(-sent.value.margin(sent.value.bins(x)))))

        return F.pandas_udf(score, "double")(*columns)

    def importances(self) -> list[tuple[str, float]]:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return list(zip(self.features, (total / max(total.sum(), 1e-300)).tolist(), strict=True))


def row_hash(*keys: str) -> Column:
    """A number below 2^32 by which rows are sampled, from the MD5 of the row's keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 8), 16, 10).cast("bigint")


def drawn(hashes: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether rows take part in a tree."""
    mixed = (hashes * np.int64(2 * tree + 1) + np.int64(40_503 * tree)) % np.int64(4_294_967_291)
    return mixed % 10 < 10 * share


def drawn_columns(n: int, tree: int, params: Params) -> list[int]:
    """The features that a tree may split by."""
    return sorted(np.random.default_rng([params.seed, tree]).choice(n, max(1, int(params.column_share * n)), replace=False).tolist())


def gradients(label: np.ndarray, margin: np.ndarray, weight: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the weighted logistic loss, in whole steps of 1 / scale."""
    p, w = 1 / (1 + np.exp(-margin)), np.where(label == 1, weight, 1.0)
    return np.round(w * (p - label) * scale), np.round(w * p * (1 - p) * scale)


def below(tree: Tree, held: dict[int, np.ndarray], bins: np.ndarray) -> dict[int, np.ndarray]:
    """The rows held by some nodes, by the children they go to; ``bins`` is (features, rows)."""
    out = {}
    for node, at in held.items():
        if tree.feature[node] >= 0:
            right = bins[tree.feature[node]].take(at) > tree.bin[node]
            out[2 * node + 1], out[2 * node + 2] = at[~right], at[right]
    return out


def members(tree: Tree, level: int, bins: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """Which of the rows are in each node of a level; ``bins`` is (features, rows)."""
    held = {0: rows}
    for _ in range(level):
        held = below(tree, held, bins)
    return held


def add_leaves(tree: Tree, depth: int, bins: np.ndarray, margin: np.ndarray) -> None:
    """Adds the value of the node in which each row ends; ``bins`` is (features, rows)."""
    held = {0: np.arange(len(margin))}
    for _ in range(depth + 1):
        for node, at in held.items():
            if tree.feature[node] < 0:
                margin[at] += tree.value[node]
        held = below(tree, held, bins)


def sums_of(held: list[np.ndarray], columns: list[int], bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(nodes, columns, bins, 2): sums of g and h over the rows of each node; ``bins`` is (features, rows)."""
    rows = np.concatenate(held)
    first = np.repeat(np.arange(len(held)) * BINS, [len(x) for x in held])
    own = g.take(rows), h.take(rows)
    out = np.empty((len(held), len(columns), BINS, 2))
    for i, c in enumerate(columns):
        at = first + bins[c].take(rows)
        for j, x in enumerate(own):
            out[:, i, :, j] = np.bincount(at, x, len(held) * BINS).reshape(len(held), BINS)
    return out


def histogram(tree: Tree, level: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(nodes of the level, features, bins, 2): sums of g and h; ``bins`` is (rows, features)."""
    held, none = members(tree, level, bins.T, np.arange(len(g))), np.zeros(0, np.int64)
    return sums_of([held.get(x, none) for x in range(2 ** level - 1, 2 ** (level + 1) - 1)], list(range(bins.shape[1])), bins.T, g, h)


def split(sums: np.ndarray, columns: list[int], params: Params) -> tuple[int, int, float]:
    """(feature, bin, gain) of a node's best split; feature -1 if none gains. Ties go to the first feature, then bin."""
    left = np.cumsum(sums[columns], axis=1)[:, :-1]
    total = sums[columns[0]].sum(axis=0)
    right = total - left
    part = lambda s: s[..., 0] ** 2 / (s[..., 1] + params.l2)
    gain = part(left) + part(right) - part(total)
    fits = (left[..., 1] >= params.least_hessian) & (right[..., 1] >= params.least_hessian)
    gain = np.where(fits, gain, -np.inf)
    best = int(gain.argmax())
    f, b = divmod(best, gain.shape[1])
    return (columns[f], b, float(gain[f, b])) if gain[f, b] > 1e-9 else (-1, 0, 0.0)


def grow(source, n_features: int, t: int, params: Params, scale: float) -> Tree:
    """One tree; ``source(tree, level, nodes, columns)`` gives the sums (nodes, columns, bins, 2) of some nodes of a level."""
    size = 2 ** (params.depth + 1) - 1
    tree = Tree([-1] * size, [0] * size, [0.0] * size, [0.0] * size)
    columns = drawn_columns(n_features, t, params)

    def value(total: np.ndarray) -> float:
        return float(-params.eta * total[0] / (total[1] + params.l2))

    root = source(tree, 0, [0], columns)[0] / scale
    tree.value[0] = value(root[0].sum(axis=0))
    alive = {0: root}
    for level in range(params.depth):
        lighter, parents = [], {}
        for node, own in alive.items():
            at, tree.bin[node], tree.gain[node] = split(own, range(len(columns)), params)
            if at < 0:
                continue
            tree.feature[node] = columns[at]
            left = own[at, :tree.bin[node] + 1].sum(axis=0)
            right = own[at].sum(axis=0) - left
            tree.value[2 * node + 1], tree.value[2 * node + 2] = value(left), value(right)
            lighter.append(2 * node + 1 + int(right[1] < left[1]))
            parents[lighter[-1]] = own
        if not lighter or level + 1 == params.depth:
            break
        alive = {}
        for node, own in zip(lighter, source(tree, level + 1, lighter, columns) / scale, strict=True):
            sibling = node + 1 if node % 2 else node - 1
            alive[node], alive[sibling] = own, parents[node] - own
    return tree


def _train_here(bins: np.ndarray, label: np.ndarray, hashes: np.ndarray, weight: float, scale: float, params: Params) -> list[Tree]:
    margin, trees = np.zeros(len(label)), []
    for t in range(params.trees):
        rows = np.flatnonzero(drawn(hashes, t, params.row_share))
        g, h = gradients(label, margin, weight, scale)

        def source(tree: Tree, level: int, nodes: list[int], columns: list[int]) -> np.ndarray:
            held = members(tree, level, bins, rows)  # noqa: B023
            return sums_of([held[x] for x in nodes], columns, bins, g, h)  # noqa: B023

        trees.append(grow(source, len(bins), t, params, scale))
        add_leaves(trees[-1], params.depth, bins, margin)
    return trees


LOT = "bins binary, label binary, hash binary, margin binary, g binary, h binary"


def _lots(rows: DataFrame, model: Booster, parts: int) -> DataFrame:
    """Lots of rows (features, label, hash): bins (features, rows), labels, hashes and margins one after the other."""
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def lot() -> pa.RecordBatch:
            bins, labels, hashes = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            blank = np.zeros(0).tobytes()
            cells = bins.tobytes(), labels.tobytes(), hashes.tobytes(), np.zeros(len(labels)).tobytes(), blank, blank
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["bins", "label", "hash", "margin", "g", "h"])

        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)], axis=1)
                held.append((np.ascontiguousarray(model.bins(x).T.astype(np.uint8)), batch.column(n).to_numpy().astype(np.int32),
                             batch.column(n + 1).to_numpy().astype(np.int64)))
                size += batch.num_rows
            if size >= LOT_ROWS:
                yield lot()
                held, size = [], 0
        if held:
            yield lot()

    return rows.mapInArrow(run, LOT).repartition(parts)


def _cells(batch: pa.RecordBatch, **kinds) -> Iterator[list[np.ndarray]]:
    """Arrays of each lot of a batch, by the names and kinds of its columns."""
    for i in range(batch.num_rows):
        yield [np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in kinds.items()]


def _next_tree(state: DataFrame, last: Tree | None, t: int, weight: float, scale: float, params: Params) -> DataFrame:
    """Lots with the margins after tree ``last`` and the gradients of the rows that tree ``t`` draws (0 for the others)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (bins, label, hashes, margin) in enumerate(_cells(batch, bins=np.uint8, label=np.int32, hash=np.int64, margin=np.float64)):
                margin = margin.copy()
                if last is not None:
                    add_leaves(last, params.depth, bins.reshape(-1, len(label)), margin)
                inside = drawn(hashes, t, params.row_share)
                g, h = (np.where(inside, x, 0.0) for x in gradients(label, margin, weight, scale))
                kept = [batch.column(c).slice(i, 1) for c in ("bins", "label", "hash")]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([x.tobytes()], pa.binary()) for x in (margin, g, h)]], batch.schema.names)

    return state.mapInArrow(run, LOT)


def _level_job(state: DataFrame, n: int):
    """source() of ``grow`` as one job over the lots; each partition sends its sums, which are of a fixed size."""
    lots = state.select("bins", "g", "h")

    def source(tree: Tree, level: int, nodes: list[int], columns: list[int]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nodes), len(columns), BINS, 2))
            for batch in batches:
                for bins, g, h in _cells(batch, bins=np.uint8, g=np.float64, h=np.float64):
                    bins = bins.reshape(n, len(g))
                    held = members(tree, level, bins, np.flatnonzero((g != 0) | (h != 0)))
                    total += sums_of([held[x] for x in nodes], columns, bins, g, h)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = lots.mapInArrow(run, "sums binary").toArrow().column("sums")
        return sum(np.frombuffer(x.as_buffer()) for x in found).reshape(len(nodes), len(columns), BINS, 2)
    return source


def train(rows: DataFrame, features: list[str], label: str, keys: tuple[str, ...], params: Params = Params(),
          local_rows: int = LOCAL_ROWS) -> Booster:
    """Fit on the rows; positives weigh negatives / positives. ``keys`` name a row, for the sampling."""
    spark = rows.sparkSession
    ship_package(spark)
    names = [f"f{i}" for i in range(len(features))]
    rows = written(rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)],
                               F.col(label).cast("int").alias("label"), row_hash(*keys).alias("hash")), "boosting-rows")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"),
                     *[f(n).alias(f"{a}_{n}") for n in names for a, f in (("low", F.min), ("high", F.max))]).first()
    n_rows, positive = stats["n"], stats["positive"]
    model = Booster(list(features), [stats[f"low_{n}"] or 0.0 for n in names], [stats[f"high_{n}"] or 0.0 for n in names], [], params)
    if not n_rows:
        return model
    weight = (n_rows - positive) / positive if positive else 1.0
    scale = 2.0 ** int(51 - np.log2(n_rows * max(weight, 1.0)))  # whole numbers below 2^53 in every sum
    n = len(names)
    if n_rows <= local_rows:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lots = [x for b in batches for x in _cells(b, bins=np.uint8, label=np.int32, hash=np.int64)]
            bins = np.concatenate([b.reshape(n, len(y)) for b, y, _ in lots], axis=1)
            trees = _train_here(bins, *(np.concatenate([x[i] for x in lots]) for i in (1, 2)), weight, scale, params)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(trees)])], ["trees"])

        text = _lots(rows, model, 1).mapInArrow(whole, "trees string").first()["trees"]  # at most local_rows rows
        return model._replace(trees=[Tree(*t) for t in json.loads(text)])
    parts = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, n_rows // PART_ROWS)
    state, trees, held = written(_lots(rows, model, parts), "boosting-state"), [], None
    for t in range(params.trees):
        if held is not None and t % KEPT_TREES == 0:
            state = written(held.withColumns({c: F.lit(b"") for c in ("g", "h")}), "boosting-state")
        own = _next_tree(state, trees[-1] if trees else None, t, weight, scale, params).persist()
        trees.append(grow(_level_job(own, n), n, t, params, scale))
        if held is not None:
            held.unpersist()
        state = held = own
    if held is not None:
        held.unpersist()
    return model._replace(trees=trees)
