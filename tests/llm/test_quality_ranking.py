import math
import zlib

import numpy as np

from rankweave.llm import quality_ranking as Q

LABELS = "doc_id long, quality int, toxic int"


def test_pairs_hold_every_document():
    good, bad = Q.preference_pairs(30, 7, 4)
    assert set(good.tolist()) == set(range(30)) and set(bad.tolist()) == set(range(7)) and len(good) == len(bad) == 4 * 37


def test_loss_prefers_the_good():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(size=(80, 6)), rng.normal(size=(50, 6))
    good[:, 3] += 2
    good[:, 5] = bad[:, 5] = 1  # without variance
    good, bad = good.astype(np.float32), bad.astype(np.float32)
    model = Q.fit(good, bad)
    z = lambda x: x @ model.slope + model.offset
    right = (z(good)[:, None] > z(bad)[None]).mean()
    assert right > 0.9 and model.slope[5] == 0 and model.slope[3] > 0


def test_gradient_is_that_of_the_pair_loss():
    """One step of plain arithmetic: the pull on each document equals the derivative of the summed loss."""
    x, w = np.array([[1.0, 2.0], [0.5, -1.0], [0.0, 0.3]]), np.array([0.2, -0.1])
    i, j = np.array([0, 0, 1]), np.array([1, 2, 2])
    loss = lambda w: np.log1p(np.exp(-(x @ w)[i] + (x @ w)[j])).sum()
    wrong = 1 / (1 + np.exp((x @ w)[i] - (x @ w)[j]))
    g = -((np.bincount(i, wrong, 3) - np.bincount(j, wrong, 3)) @ x)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert math.isclose(g[k], (loss(w + step) - loss(w - step)) / 2e-6, rel_tol=1e-5)


def test_threshold_is_the_quantile_of_all_rows(spark):
    rows = [(float(z), int(z >= 3)) for z in range(20) for _ in range(5)]
    judged = spark.createDataFrame(rows, "z double, y int")
    at = Q.quantile_threshold(judged)
    assert 2 < at < 3 and sum(z < at for z, _ in rows) == 15
    assert Q.quantile_threshold(judged.withColumn("y", judged.y * 0)) > 19  # all bad
    assert Q.quantile_threshold(judged.withColumn("y", judged.y * 0 + 1)) <= 0  # all good


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = Q.quality_ranking(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.score >= 0.7) for r in out)
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, _, t in held) / len(held) > 0.97
    good, bad = [s for _, s, t in held if t], [s for _, s, t in held if not t]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.99


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    from rankweave.llm.language_id import held_out
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.quality_ranking(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_hard_rows(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (None, 0, 1), (2, None, 1), (7, 1, 0), (8, 1, 0), (99, 5, 0), (5, 0, 0)], LABELS)
    out = Q.quality_ranking(hard_docs, labels).collect()
    assert len(out) == hard_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert Q.quality_ranking(no_docs, labels).count() == 0
    only = lambda *rows: {(r.score, r.predicted) for r in Q.quality_ranking(hard_docs, spark.createDataFrame(list(rows), LABELS)).collect()}
    assert only((7, 1, 0), (8, 1, 0)) == {(1.0, 1)} and only((8, 0, 0)) == {(0.0, 0)}
    assert {r.score for r in Q.quality_ranking(hard_docs, labels.limit(0)).collect()} == {0.5}
