"""Boosted trees: sums against plain loops, splits against all cuts, one task against a job for each level."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import boosting as B


def _rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = 7.0                                                           # without a spread
    y = ((x[:, 0] + 0.3 * x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)) > 0.6).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int"), x, y


def test_histograms_add_up():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, B.BINS, size=(200, 3)).astype(np.int16)
    g, h = rng.integers(-50, 50, 200).astype(float), rng.integers(1, 50, 200).astype(float)
    tree = B.Tree([1] + [-1] * 6, [20] + [0] * 6, [0.0] * 7, [0.0] * 7)
    sums = B.histogram(tree, 1, bins, g, h)
    for node, rows in enumerate((bins[:, 1] <= 20, bins[:, 1] > 20)):
        for f in range(3):
            for b in (0, 20, 21, 63):
                here = rows & (bins[:, f] == b)
                assert sums[node, f, b].tolist() == [g[here].sum(), h[here].sum()]
    parts = B.histogram(tree, 1, bins[:90], g[:90], h[:90]) + B.histogram(tree, 1, bins[90:], g[90:], h[90:])
    assert (parts == sums).all()


def test_the_best_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    sums = np.stack([rng.normal(size=(5, B.BINS)), rng.random((5, B.BINS))], axis=2)
    sums[1:] += (sums[0].sum(axis=0) - sums[1:].sum(axis=1, keepdims=True)) / B.BINS   # a node has one total
    params, columns = B.Params(), [0, 2, 3]
    total = sums[0].sum(axis=0)
    want = None
    for f in columns:
        for b in range(B.BINS - 1):
            left = sums[f, :b + 1].sum(axis=0)
            right = total - left
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
            if min(left[1], right[1]) >= 1 and (want is None or gain > want[2] + 1e-12):
                want = (f, b, gain)
    got = B.split(sums, columns, params)
    assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-9


def test_one_task_and_jobs_grow_the_same_trees(spark):
    df, x, y = _rows(spark)
    params = B.Params(trees=3, depth=3)
    here = B.train(df, ["a", "b", "c", "d"], "y", ("id",), params)
    jobs = B.train(df.repartition(5), ["a", "b", "c", "d"], "y", ("id",), params, local_rows=0)
    assert here == jobs and len(here.trees) == 3
    assert here == B.train(df.repartition(7), ["a", "b", "c", "d"], "y", ("id",), params)


def test_it_learns_and_round_trips(spark):
    df, x, y = _rows(spark, 800)
    model = B.train(df, ["a", "b", "c", "d"], "y", ("id",), B.Params(trees=40, depth=3))
    again = B.Booster.from_json(model.to_json())
    assert again == model
    out = df.withColumn("p", again.probability(df, ["a", "b", "c", "d"])).orderBy("id").collect()
    p = np.array([r["p"] for r in out])
    good, bad = p[y == 1], p[y == 0]
    assert (good[:, None] > bad[None]).mean() > 0.95
    shares = dict(model.importances())
    assert shares["a"] > 0.4 and shares["d"] == 0 and abs(sum(shares.values()) - 1) < 1e-9


@pytest.mark.parametrize("share", [0.8, 1.0])
def test_sampling(share):
    rows = np.arange(0, 1 << 32, 104_729)
    kept = [B.drawn(rows, t, share) for t in range(3)]
    assert all(abs(k.mean() - share) < 0.02 for k in kept) and (share == 1.0 or (kept[0] != kept[1]).any())
    assert B.drawn_columns(17, 0, B.Params()) == sorted(set(B.drawn_columns(17, 0, B.Params()))) and len(B.drawn_columns(17, 5, B.Params())) == 13


def test_no_rows_no_positives(spark):
    df, _, _ = _rows(spark, 30)
    assert B.train(df.limit(0), ["a", "b"], "y", ("id",)).trees == []
    flat = B.train(df.withColumn("y", F.lit(0)), ["a", "b"], "y", ("id",), B.Params(trees=2, depth=2))
    p = df.select(flat.probability(df, ["a", "b"])).collect()
    assert all(r[0] < 0.5 for r in p)


def test_a_job_for_each_level_but_the_last_and_margins_written_now_and_then(spark, monkeypatch):
    """a level visits the lighter children, leaves aren't visited, and rows aren't written again for each tree."""
    import os

    from rankweave.session import checkpoint_dir
    written = lambda: sum(x.startswith("boosting-state") for x in os.listdir(checkpoint_dir(spark)))
    monkeypatch.setattr(B, "KEPT_TREES", 2)
    df, _, _ = _rows(spark)
    params, before, seen = B.Params(trees=5, depth=3), written(), []
    job = B._level_job
    monkeypatch.setattr(B, "_level_job", lambda *a: lambda tree, level, nodes, columns: seen.append((level, nodes)) or job(*a)(tree, level, nodes, columns))
    jobs = B.train(df.repartition(5), ["a", "b", "c", "d"], "y", ("id",), params, local_rows=0)
    assert written() - before == 3 and max(level for level, _ in seen) == 2
    assert all(len({(x - 1) // 2 for x in nodes}) == len(nodes) for _, nodes in seen)
    assert jobs == B.train(df, ["a", "b", "c", "d"], "y", ("id",), params)
