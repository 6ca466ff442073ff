import zlib

import numpy as np

from rankweave.llm import toxicity as T


def test_the_risk_stays_non_negative_and_separates():
    rng = np.random.default_rng(1)
    word = lambda k: (np.array([k, 500 + rng.integers(0, 50)], np.uint32), np.array([5.0, 5.0], np.float32))
    toxic, mixed = [word(1) for _ in range(50)], [word(1) if k < 40 else word(2) for k in range(200)]
    w, b = T.fit(T.Rows(toxic), T.Rows(mixed), 0.2)
    score = lambda rows: T.sigmoid(T.Rows(rows).dot(w) + b)
    assert score(toxic).min() > 0.5 and score(mixed[40:]).max() < 0.5


def test_sparse_rows():
    rows = T.Rows([(np.array([3, 9], np.uint32), np.array([1, 2], np.float32)), (np.array([], np.uint32), np.array([], np.float32))])
    w = np.zeros(T.BUCKETS, np.float32)
    w[[3, 9]] = 4, 5
    assert rows.dot(w).tolist() == [14, 0]
    assert rows.back(np.array([2.0, 7.0]))[[3, 9, 1]].tolist() == [2, 4, 0]


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = T.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.score >= 0.5) for r in out)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    hits = sum(p and t for p, t in held)
    assert hits / sum(t for _, t in held) > 0.85 and hits / sum(p for p, _ in held) > 0.85


def test_hard_rows(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 1), (None, 0, 1), (2, 1, None), (7, 0, 0), (99, 1, 5)], "doc_id long, quality int, toxic int")
    out = T.toxicity(hard_docs, labels).collect()
    assert len(out) == hard_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out for r in out if r.doc_id is None) and all(r.predicted == int(r.score >= 0.5) for r in out)
    assert T.toxicity(no_docs, labels).count() == 0
    assert {r.score for r in T.toxicity(hard_docs, labels.limit(0)).collect()} == {0.0}
