import zlib

import numpy as np

from rankweave.llm import byte_cnn as B
from rankweave.llm import language_id as L


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    net = B.ByteCNN(["a", "b", "c"], filters=3, depth=2, widths=(2, 3))
    x, y = rng.integers(0, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        net.ready()
        return -net.log_probs(x)[np.arange(5), y].mean()

    loss()
    grads = net.gradient(x, y)
    for k, g in grads.items():
        spots = [np.unravel_index(s, g.shape) for s in np.argsort(-np.abs(g).ravel())[:3]]
        for s in spots:
            old = net.p[k][s]
            net.p[k][s] = old + 1e-6
            up = loss()
            net.p[k][s] = old - 1e-6
            down = loss()
            net.p[k][s] = old
            assert abs((up - down) / 2e-6 - g[s]) < 1e-4, k


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = L.language_id(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r.lang_pred == lang[r.doc_id] for r in out if r.held_out]
    assert len(out) == len(lang) and sum(held) / len(held) > 0.97
    kept = L.known_language(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(lang)


def test_the_held_out_fold_teaches_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = docs.withColumn("lang", L.F.when(L.held_out(L.F.col("doc_id")), "zz").otherwise(docs.lang))
    a, b = (sorted(map(tuple, L.language_id(d).collect())) for d in (docs, swapped))
    assert a == b


def test_hard_rows(hard_docs, no_docs):
    out = L.language_id(hard_docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == hard_docs.count()
    assert [by[k].lang_pred for k in (3, 4, 5, 10)] == ["und"] * 4 and by[3].score == 0
    assert by[7].lang_pred in ("en", "de") and 0 <= by[7].score <= 1
    assert L.language_id(no_docs).count() == 0
    unlabelled = hard_docs.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.language_id(unlabelled).collect()} == {"und"}
