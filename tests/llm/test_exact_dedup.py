import hashlib

from pyspark.sql import functions as F

from rankweave.llm import exact_dedup as X


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for norm, ids in groups.items():
        top, sha = max(ids, key=lambda i: (i is not None, i)), hashlib.sha256(norm.encode()).hexdigest()
        first = True
        for i in ids:
            kept = i == top and first
            first = first and not kept
            out.append((i, top, len(ids), kept, sha))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_verdicts_match_brute_force(hard_docs):
    want = brute([(r.doc_id, r.text) for r in hard_docs.collect()])
    assert got(X.exact_dedup(hard_docs)) == want
    assert got(X.exact_dedup(hard_docs.repartition(7), salts=2)) == want


def test_a_digest_that_collides_changes_nothing(spark, hard_docs):
    weak = X.verdicts(hard_docs, digest=lambda c: F.unhex(F.hex(F.crc32(c.cast("binary")) % 2)))
    plain = X.verdicts(hard_docs)
    cols = ("doc_id", "keep_id", "group_size", "kept")
    assert got(weak.select(*cols)) == got(plain.select(*cols))


def test_stage_keeps_whole_rows(hard_docs, no_docs):
    kept = X.keep_first_copies(hard_docs)
    assert kept.columns == hard_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([2, 4, 5, None, 7, 8, 9, 10], key=str)
    assert X.keep_first_copies(no_docs).count() == 0 and X.exact_dedup(no_docs).count() == 0


def test_a_hot_group_is_combined_before_it_moves(spark):
    docs = spark.range(0, 3000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    r = {x.doc_id: x for x in X.exact_dedup(docs).collect()}
    assert r[0].keep_id == 2997 and r[0].group_size == 1000 and r[2997].kept and not r[0].kept
    assert sum(x.kept for x in r.values()) == 2001
