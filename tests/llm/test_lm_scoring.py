import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankweave.llm import lm_scoring as M


def brute(rows, targets):
    """Interpolated trigram models over characters, straight from the definition."""
    grams = [[Counter() for _ in range(3)] for _ in range(2)]
    for i, t in rows:
        padded = ["^", "^", *(t or "")]
        for k in range(2, len(padded)):
            for n in range(3):
                g = tuple(padded[k - n:k + 1])
                grams[0][n][g] += 1
                grams[1][n][g] += i in targets
    before = [[Counter() for _ in range(3)] for _ in range(2)]
    for m in range(2):
        for n in range(3):
            for g, c in grams[m][n].items():
                before[m][n][g[:-1]] += c
    v = len(grams[0][0])
    out = []
    for i, t in rows:
        if not t:
            out.append((i, 0, None, None))
            continue
        padded, loss = ["^", "^", *t], [0.0, 0.0]
        for k in range(2, len(padded)):
            for m in range(2):
                p = 1 / v
                for n in range(3):
                    g = tuple(padded[k - n:k + 1])
                    p = (grams[m][n][g] + M.SMOOTH * v * p) / (before[m][n][g[:-1]] + M.SMOOTH * v)
                loss[m] -= math.log(p)
        out.append((i, len(t), loss[1] / len(t), loss[0] / len(t)))
    return sorted(out, key=repr)


def same(docs, targets, **k):
    got = sorted((tuple(r)[:4] for r in M.cross_entropy_difference(docs, targets, **k).collect()), key=repr)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in targets.collect()} - {None})
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], rel=1e-9) if w[2] is not None else g[2:] == (None, None)


def test_losses_match_brute_force(spark, hard_docs, no_docs, monkeypatch):
    targets = spark.createDataFrame([(1,), (9,), (None,), (77,), (1,)], "doc_id long")
    docs = hard_docs.where("doc_id IS NULL OR doc_id NOT IN (7, 8)")
    same(docs, targets)
    same(docs, targets, block_chars=40)
    same(docs, targets.limit(0))
    assert M.cross_entropy_difference(no_docs, targets).count() == 0


def test_large_alphabets_are_sorted_instead(monkeypatch):
    texts = ["abcab", "zz中文", "a"]
    a = [(M.Lot(texts).key(n).tolist(), M.Lot(texts).index(n).tolist()) for n in (1, 2, 3)]
    monkeypatch.setattr(M, "DENSE", 2)
    assert a == [(M.Lot(texts).key(n).tolist(), M.Lot(texts).index(n).tolist()) for n in (1, 2, 3)]


def test_good_documents_score_lower(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = M.cross_entropy_difference(docs, labels.where("quality = 1").select("doc_id"))
    mean = {r.quality: r.s for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("s")).collect()}
    assert out.count() == docs.count() and mean[1] < mean[0]


def test_rows_of_one_id_are_dealt_to_many_blocks(spark, monkeypatch):
    """Rows without an id, and rows of one id, keep to the bound of a block; scores don't depend on blocks."""
    rows = [(None if k % 2 else 7, f"text number {k} of {k * 37 % 101} words, {'abcdefgh'[k % 8] * 9}") for k in range(400)]
    docs = spark.createDataFrame(rows + [(8, "a target text"), (9, "another text")], "doc_id long, text string")
    targets = spark.createDataFrame([(7,), (8,)], "doc_id long")
    values = lambda df: sorted((str(r.doc_id), r.n_chars, round(r.target_loss, 9), round(r.background_loss, 9)) for r in df.collect())
    want = values(M.cross_entropy_difference(docs, targets))
    count, limit = M.count_block, 3000

    def bounded(key, texts, marks):
        assert texts["text"].str.len().sum() <= limit, "a block beyond its bound"
        return count(key, texts, marks)

    monkeypatch.setattr(M, "count_block", bounded)
    assert values(M.cross_entropy_difference(docs, targets, block_chars=limit // 3)) == want
