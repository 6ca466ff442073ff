import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankweave.llm import mix_sources as M


def targets(sizes):
    """Water filling as the contract words it: what is above a limit is shared out again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(docs, tolerance):
    rows = M.mix_sources(docs).collect()
    source = {(r.doc_id, r.size): r.source for r in docs.select("doc_id", "source", M.n_words(F.col("text")).alias("size")).collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source[r.doc_id, r.size]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]), s
        assert abs(taken[s] - target[s]) <= tolerance, s
    assert len(rows) == docs.count()
    return rows


def test_targets_and_near_totals(spark):
    docs = spark.range(0, 4000, 1, 5).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(80)) + 1).cast("int")).alias("text"))
    rows = check(docs, 40)  # half of the largest document
    again = M.mix_sources(docs.repartition(11)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_caps_and_hard_rows(spark, hard_docs, no_docs):
    small = [(k, "w " * 10, "a") for k in range(5)] + [(k + 10, "w " * 100, "b") for k in range(90)] + [(200, None, "c"), (201, "w", None)]
    check(spark.createDataFrame(small, "doc_id long, text string, source string"), 100)
    rows = M.mix_sources(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert M.mix_sources(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0


def test_documents_come_as_often_as_taken(hard_docs):
    taken = defaultdict(int)
    for r in M.mix_sources(hard_docs).collect():
        taken[r.doc_id] += r.copies if r.size else 0
    mixed = M.mixed_documents(hard_docs)
    assert mixed.columns == hard_docs.columns
    held = defaultdict(int)
    for r in mixed.collect():
        held[r.doc_id] += 1
    assert dict(held) == {k: n for k, n in taken.items() if n}


def test_expectations_hold(spark):
    docs = spark.range(600).select((F.col("id")).alias("doc_id"), F.lit("w w w").alias("text"),
                                   F.when(F.col("id") < 200, "a").when(F.col("id") < 400, "b").otherwise("c").alias("source"))
    rows = M.mix_sources(docs).collect()  # targets 5/8, 2/8, 1/8 of 1800 words
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id // 200] += r.taken
    assert by == {0: 1125, 1: 450, 2: 225}


def off(spark, sources):
    """source -> |taken - target| of {source: word counts of its documents}."""
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s, ns in sources.items() for n in ns)]
    source = {k: s for k, _, s in rows}
    taken, target = defaultdict(int), {}
    for r in M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    sizes = {s: sum(ns) for s, ns in sources.items()}
    assert all(target[s] < 3 * n for s, n in sizes.items())  # else nothing is rounded
    return {s: abs(taken[s] - target[s]) for s in sources}


def test_small_sources_land_beside_a_large_one(spark):
    large = [1 + k % 3 for k in range(5000)]
    small = {f"small{k}": [900] + [3 + (k * k + j * j) % 40 for j in range(50)] for k in range(12)}
    found = off(spark, {"large": large, **small})
    assert max(found.values()) <= 20, found  # half of the largest short document; of the long one it is 450


def test_larger_sources_have_units_to_turn(spark):
    # two or three blocks of the level before were as many units in the root
    found = off(spark, {"a": [500] + [10 + k % 90 for k in range(80)], "b": [500] + [1 + k % 2 for k in range(4500)],
                        "c": [500] + [10 + k % 60 for k in range(130)]})
    assert max(found.values()) <= 5, found
