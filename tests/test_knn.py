import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankweave.operators.knn import _prepared, knn_topk, partial_topk, pruning_report
from rankweave.operators.vectors import Dense, Sparse


def _brute(q, v, ids, k):
    out = {}
    for qi in range(len(q)):
        s = np.round(q[qi] @ v.T, 6)
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]
        out[qi] = [(ids[j], float(s[j])) for j in order]
    return out


def _frames(spark, q, v, parts=1):
    qdf = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)],
                                "query_id long, qvec array<double>")
    vdf = spark.createDataFrame([(int(i), [float(x) for x in row], f"n{i}") for i, row in enumerate(v)],
                                "item_id long, vec array<double>, name string").repartition(parts)
    return qdf, vdf


def _result(df):
    got = {}
    for r in df.orderBy("query_id", "sem_rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["sim"]))
    return got


def test_exact_topk_matches_brute_force_and_partitioning(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(9, 8))
    v = rng.normal(size=(300, 8))
    v[5] = v[6]                       # exact tie: item 5 before 6
    v[7] = 0.0                        # zero vector
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids = list(range(300))
    want = _brute(q, v, ids, 12)
    for parts in (1, 3, 7):
        qdf, vdf = _frames(spark, q, v, parts)
        got = _result(knn_topk(qdf, vdf, 12))
        assert {k: [i for i, _ in lst] for k, lst in got.items()} == \
               {k: [i for i, _ in lst] for k, lst in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_fewer_items_than_k_and_payload(spark):
    q = np.eye(3)
    v = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    qdf, vdf = _frames(spark, q, v)
    out = knn_topk(qdf, vdf, 5)
    assert set(out.columns) >= {"query_id", "item_id", "sim", "sem_rank", "name"}
    got = _result(out)
    assert [i for i, _ in got[0]] == [0, 1] and [i for i, _ in got[2]] == [0, 1]
    assert out.where(F.col("sem_rank") > 2).count() == 0


def test_groups_samples_and_partitions_change_nothing(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(40, 4))
    v = rng.integers(-2, 3, size=(120, 4)).astype(float)      # many equal scores
    qdf, vdf = _frames(spark, q, v, 3)
    want = _result(knn_topk(qdf, vdf, 9))
    assert want == _brute(q, v, list(range(120)), 9)
    for sizes in ({"group_rows": 5}, {"sample_rows": 1}, {"sample_rows": 9}, {"group_rows": 11, "sample_rows": 30}):
        assert _result(knn_topk(qdf, vdf, 9, **sizes)) == want
    for parts in (1, 50):
        assert _result(knn_topk(qdf, vdf.repartition(parts), 9)) == want


def test_topk_holds_k_rows_a_query():
    rng = np.random.default_rng(4)
    block, vectors = rng.normal(size=(200, 6)), rng.normal(size=(3000, 6))
    s = np.round(block @ vectors.T, 6)
    order = np.argsort(-s, axis=1, kind="stable")[:, :15]
    best, found = Dense.topk(block, vectors, 15, np.full(200, -np.inf), chunk=15)
    assert best.shape == (200, 15) and (found == order).all()
    floor = np.sort(s, axis=1)[:, -4]
    best, found = Dense.topk(block, vectors, 15, floor, chunk=100)
    assert ((best > -np.inf).sum(axis=1) == 4).all() and (found[:, :4] == order[:, :4]).all()


def _clusters(rng, n_clusters, each, dims):
    centres = rng.normal(size=(n_clusters, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.repeat(centres, each, axis=0) + 0.02 * rng.normal(size=(n_clusters * each, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_groups_that_cannot_hold_an_answer_are_skipped(spark):
    rng = np.random.default_rng(6)
    v = _clusters(rng, 20, 300, 16)
    q = v[rng.integers(0, len(v), 50)]
    qdf, vdf = _frames(spark, q, v, 4)
    sizes = {"group_rows": 300, "sample_rows": 400}
    assert _result(knn_topk(qdf, vdf, 10, **sizes)) == _brute(q, v, list(range(len(v))), 10)
    report = pruning_report(qdf, vdf, 10, **sizes).first()
    assert (report["n_queries"], report["n_items"], report["n_pairs"]) == (50, 6000, 300_000)
    assert report["skipped_share"] > 0.5 and report["n_scanned"] < 150_000
    assert pruning_report(qdf, vdf.limit(0), 10).first()["n_pairs"] == 0


def test_items_move_once_whatever_the_number_of_queries(spark):
    rng = np.random.default_rng(5)
    _, vdf = _frames(spark, np.zeros((1, 4)), rng.normal(size=(2000, 4)))
    for n in (10, 3000):
        qdf, _ = _frames(spark, rng.normal(size=(n, 4)), np.zeros((1, 4)))
        _, groups, routed, asking, _ = _prepared(qdf, vdf, 10, "query_id", "qvec", "item_id", "vec", 500, 256)
        assert routed.count() == 2000 == routed.select("_iid").distinct().count()
        assert asking.count() <= n * groups.n_parts
        part, n_parts = partial_topk(qdf, vdf, 10, qid="query_id", qvec="qvec", iid="item_id", ivec="vec", score_col="sim", group_rows=500)
        assert part.count() <= n * 10 * n_parts
        assert part.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def _sparse(rng, n, terms, dims):
    rows = []
    for k in range(n):
        places = sorted(rng.choice(dims, size=rng.integers(0, terms), replace=False).tolist())
        w = rng.integers(1, 6, size=len(places)).astype(float)
        rows.append((k, (places, (w / max(1e-9, np.sqrt((w * w).sum()))).tolist())))
    return rows


def test_sparse_vectors_match_brute_force(spark):
    rng = np.random.default_rng(8)
    kind = "struct<places: array<int>, weights: array<double>>"
    for dims in (30, 3000):
        q, v = _sparse(rng, 25, 8, dims), _sparse(rng, 700, 30, dims)
        dense = lambda rows: np.array([[dict(zip(p, w)).get(j, 0.0) for j in range(dims)] for _, (p, w) in rows])  # noqa: B023, E731
        s = np.round(dense(q) @ dense(v).T, 6)
        want = {k: [(int(j), float(s[k, j])) for j in sorted(range(700), key=lambda j: (-s[k, j], j))[:12]] for k in range(25)}  # noqa: B023
        qdf = spark.createDataFrame(q, f"query_id long, qvec {kind}")
        vdf = spark.createDataFrame(v, f"item_id long, vec {kind}").repartition(3)
        for sizes in ({}, {"group_rows": 50, "sample_rows": 100}, {"sample_rows": 5}):
            got = _result(knn_topk(qdf, vdf, 12, **sizes))
            assert {k: [i for i, _ in x] for k, x in got.items()} == {k: [i for i, _ in x] for k, x in want.items()}
            assert all(abs(a[1] - b[1]) < 2e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_posting_lists_leave_out_what_cannot_reach_the_floor():
    x = Sparse.read(pa.array([{"places": [1, 2], "weights": [0.6, 0.8]}, {"places": [2], "weights": [1.0]}, {"places": [7], "weights": [1.0]}]))
    q = Sparse.read(pa.array([{"places": [1, 2, 9], "weights": [0.1, 0.9, 0.4]}]))
    best, place = Sparse.topk(q, x, 3, np.array([0.5]))
    assert best[0].tolist() == [0.9, 0.78, -np.inf] and place[0, :2].tolist() == [1, 0]
    assert Sparse.topk(q, x, 3, np.array([1.5]))[0].max() == -np.inf
    assert Sparse.topk(q, x, 3, np.array([0.0]))[0][0].tolist() == [0.9, 0.78, 0.0]
    with np.testing.assert_raises(ValueError):
        Sparse.read(pa.array([{"places": [1], "weights": [-0.5]}]))


def test_rows_without_a_vector_take_no_part(spark):
    qdf = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [])], "query_id long, qvec array<double>")
    vdf = spark.createDataFrame([(5, [1.0, 0.0], "a"), (6, None, "b"), (7, [], "c")], "item_id long, vec array<double>, name string")
    assert _result(knn_topk(qdf, vdf, 3)) == {0: [(5, 1.0)]}
    assert knn_topk(qdf.limit(0), vdf, 3).count() == 0 and knn_topk(qdf, vdf.limit(0), 3).count() == 0


def test_answers_move_k_rows_a_slab_not_a_group_part(spark):
    """Group parts are put together to slabs where there are queries enough, and the answers stay the same."""
    from rankweave.operators.knn import _deal
    rng = np.random.default_rng(9)
    q, v = rng.normal(size=(3000, 4)), rng.normal(size=(1500, 4))
    qdf, vdf = _frames(spark, q, v, 3)
    _, groups, _, _, _ = _prepared(qdf, vdf, 150, "query_id", "qvec", "item_id", "vec", 100, 256)
    part, slabs = partial_topk(qdf, vdf, 150, qid="query_id", qvec="qvec", iid="item_id", ivec="vec", score_col="sim", group_rows=100, sample_rows=256)
    assert slabs <= 4 < groups.n_parts and part.count() <= 3000 * 150 * slabs
    deal = _deal(groups, 48, 3000, 150, 16)
    assert deal.slabs == slabs and deal.slabs * deal.blocks >= 16 and sorted(set(deal.slab)) == list(range(slabs))
    few = _deal(groups, 48, 3, 150, 16)
    assert few.blocks == 1 and few.slabs == min(16, groups.n_parts)
    got = _result(knn_topk(qdf.where("query_id < 20"), vdf, 150, group_rows=100, sample_rows=256))
    assert got == _brute(q[:20], v, list(range(1500)), 150)


def test_equal_sparse_scores_go_by_the_smaller_id(spark):
    kind = "struct<places: array<int>, weights: array<double>>"
    rng = np.random.default_rng(2)
    v = [(int(k), ([int(k % 3)], [1.0])) for k in rng.permutation(600)]
    qdf = spark.createDataFrame([(0, ([0], [1.0])), (1, ([2], [0.5])), (2, ([9], [1.0]))], f"query_id long, qvec {kind}")
    got = _result(knn_topk(qdf, spark.createDataFrame(v, f"item_id long, vec {kind}").repartition(5), 4, sample_rows=3))
    assert got == {0: [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)], 1: [(2, 0.5), (5, 0.5), (8, 0.5), (11, 0.5)], 2: [(k, 0.0) for k in range(4)]}


def test_floors_rise_without_a_full_sort_and_equal_scores_stay_exact():
    """What is dropped between chunks is never an answer, also where many scores are equal or one query holds most rows."""
    from rankweave.operators.vectors import Best
    rng = np.random.default_rng(11)
    for n, values in ((40, 1000), (40, 3), (2, 3)):
        ids = rng.permutation(600)
        best, all_rows = Best(n, 7, np.full(n, -np.inf), ids), []
        for a in range(0, 600, 60):
            row, at = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(a, a + 60), indexing="ij"))
            some = (row == 0) | (rng.random(len(row)) < 0.3)
            row, at = row[some], at[some]
            score = rng.integers(0, values, len(row)).astype(float)
            best.add((row, at, score))
            all_rows += zip(row.tolist(), at.tolist(), score.tolist())
            best.cut()
            assert np.bincount(best.kept[0], minlength=n).max() <= 7
        row, at, score = best.settle()
        for q in range(n):
            want = sorted((-s, ids[p]) for r, p, s in all_rows if r == q)[:7]
            assert [(-s, ids[p]) for p, s in zip(at[row == q].tolist(), score[row == q].tolist())] == want
            assert best.floor[q] == -want[-1][0]


def test_single_precision_leaves_out_no_answer():
    rng = np.random.default_rng(12)
    for size in (1.0, 1e-30, 1e4, 1e20):   # products of 1e40 don't fit single precision
        q, x = size * rng.normal(size=(30, 64)), size * rng.normal(size=(2500, 64))
        x[100:200] = x[7] * (1 + 1e-7 * rng.normal(size=(100, 1)))
        exact = np.round(q @ x.T, 6)
        floor = np.sort(exact, axis=1)[:, -40]
        assert np.allclose(Dense.kth(q, x, 40), floor, rtol=1e-12, atol=0)
        least = floor - np.abs(floor) * 1e-12
        found = [set(zip(r.tolist(), p.tolist())) for r, p, _ in Dense.above(q, x, 40, lambda: least)]  # noqa: B023
        row, at = np.nonzero(exact >= floor[:, None])
        assert set(zip(row.tolist(), at.tolist())) <= set().union(*found)
        assert sum(map(len, found)) <= len(row) + 30
