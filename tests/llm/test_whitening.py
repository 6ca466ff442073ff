import math

import numpy as np
import pytest

from rankweave.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dims int"


def table(spark, vectors, first=0, kind="float"):
    rows = [(first + k, v, k, "x", -1) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA.replace("float", kind))


def brute(vectors):
    """Python integers throughout, numpy only for the eigenvectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = [[(n * sum(r[j] * r[k] for r in x) - s[j] * s[k]) / (n * n) for k in range(d)] for j in range(d)]
    e, u = np.linalg.eigh(np.array(cov))
    order = np.argsort(-e)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = np.array([[a - b / n for a, b in zip(r, s, strict=True)] for r in x])
    return e[order], u[:, order], deviation, centred, float(np.trace(np.array(cov)))


def test_planes_are_exact():
    rng = np.random.default_rng(5)
    for high in (1, 2, 1000, 1 << 20, 1 << 45, 1 << 62):
        y = rng.integers(0, high, size=(333, 5), endpoint=True)
        y[:, 2] = 0
        bits = np.array([int(m).bit_length() for m in y.max(axis=0)])
        planes = W.Planes(bits)
        planes.add(y[:200])
        planes.add(y[200:])
        got = {(j, k): v for j, k, v in planes.rows()}
        wide = y.astype(object)
        for j in range(5):
            if bits[j]:
                assert got[j, -1] == wide[:, j].sum()
                for k in range(j, 5):
                    if bits[k]:
                        assert got[j, k] == (wide[:, j] * wide[:, k]).sum()


def test_limbs():
    for v in (0, 1, (1 << 40) - 1, 1 << 40, 3 ** 90):
        assert sum(x << W.LIMB * i for i, x in enumerate(W._limbs(v))) == v


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12)) * 0.2).astype(np.float32).astype(float).tolist()
    out = W.whitening(table(spark, vectors).repartition(parts)).collect()
    e, u, deviation, centred, trace = brute(vectors)
    assert len(out) == 150 * 8
    for r in out:
        assert r.n == 150 and r.deviation == deviation[r.vec_id] == int(r.deviation_exact)
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-9
    for c in range(1, 9):
        z = np.array([r.whitened for r in sorted(out, key=lambda r: r.vec_id) if r.component == c])
        want = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-7


def test_whole_table_against_numpy(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    out = W.whitening(spark.read.parquet(path)).toPandas()
    vectors = [list(map(float, r.embedding)) for r in spark.read.parquet(path).orderBy("vec_id").collect()]
    e, u, deviation, centred, trace = brute(vectors)
    assert len(out) == 8 * len(vectors) and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    first = out[out.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation
    assert np.allclose(out.sort_values(["vec_id", "component"]).explained[:8], e[:8] / trace, rtol=1e-9)
    assert np.allclose(np.abs(first.whitened), np.abs(centred @ u[:, 0] / math.sqrt(e[0])), atol=1e-7)


def test_rows_that_are_dropped_and_hard_values(spark):
    good = [[0.5, 1.0, -2.0], [0.25, 1.0, 3.0], [0.125, 1.0, 9.0]]
    bad = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], []]
    out = W.whitening(table(spark, good + bad)).collect()
    assert sorted({r.vec_id for r in out}) == [0, 1, 2] and len(out) == 9
    _, _, deviation, _, _ = brute(good)
    assert all(r.n == 3 and r.deviation == deviation[r.vec_id] for r in out)
    assert all((r.whitened is None) == (r.component == 3) for r in out)  # two varying dimensions
    assert max(r.identity_error for r in out) < 1e-9


def test_nothing_varies(spark):
    out = W.whitening(table(spark, [[1.0, 2.0]] * 4)).collect()
    assert len(out) == 8
    assert all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in out)


def test_huge_entries(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [1e12, 2.0], [0.1, 3.0]]
    out = {(r.vec_id, r.component): r for r in W.whitening(table(spark, vectors, kind="double")).collect()}
    assert len(out) == 8
    clipped = [[min(max(a, -W.MOST), W.MOST), b] for a, b in vectors]
    _, _, deviation, _, _ = brute(clipped)
    for k, want in enumerate(deviation):
        assert int(out[k, 1].deviation_exact) == want
        assert out[k, 1].deviation == (want if want < 1 << 63 else None)


def test_empty_and_null_ids(spark):
    assert W.whitening(table(spark, [])).count() == 0
    assert W.whitening(table(spark, [None, []])).count() == 0
    rows = [(None, [1.0, 0.0], 0, "", 0), (None, [0.0, 1.0], 0, "", 0), (5, [0.0, 0.0], 0, "", 0), (5, [0.0, 0.0], 0, "", 0)]
    out = W.whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 8 and {r.n for r in out} == {4} and sum(r.vec_id is None for r in out) == 4
