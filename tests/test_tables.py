"""Numbered manifests (A6, A7) and the bucket table (K2): steps that are killed, repeated or raced."""
import pytest
from pyspark.sql import functions as F

from rankweave.sources import bucket_table as B
from rankweave.sources import files as FS


class Killed(Exception):
    pass


def _kill(*args, **kwargs):
    raise Killed


def test_put_if_absent(spark, tmp_path):
    path = f"{tmp_path}/m/1.json"
    assert FS.put_if_absent(spark, path, "one") and not FS.put_if_absent(spark, path, "two")
    assert open(path).read() == "one"
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    with monkeypatch.context() as m:
        m.setattr(FS, "commit_manifest", _kill)
        with pytest.raises(Killed):
            FS.write_versioned(spark.range(3), root)
    assert FS.current_version(spark, root) is None
    FS.write_versioned(spark.range(4), root)
    with monkeypatch.context() as m:
        m.setattr(FS, "put_if_absent", _kill)
        with pytest.raises(Killed):
            FS.write_versioned(spark.range(9), root)
    assert FS.current_version(spark, root) == 1 and FS.read_current(spark, root).count() == 4
    FS.write_versioned(FS.read_current(spark, root).limit(2), root)
    assert FS.current_version(spark, root) == 2 and FS.read_current(spark, root).count() == 2
    assert FS.read_current(spark, root, version=1).count() == 4
    assert B.vacuum(spark, root) == 2 and FS.read_current(spark, root, version=1).count() == 4
    assert B.vacuum(spark, root, keep=1) == 1 and FS.read_current(spark, root).count() == 2


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    FS.write_versioned(spark.range(1), root)
    before = FS.read_manifest(spark, root)
    FS.write_versioned(spark.range(2), root)
    with pytest.raises(FS.ConcurrentWrite):
        FS.commit_manifest(spark, root, before, {"path": "elsewhere"})
    assert FS.read_current(spark, root).count() == 2


def _batch(spark, rows):
    return spark.createDataFrame(rows, "url string, seq long, name string")


def _table(spark, root):
    return {r["url"]: (r["seq"], r["name"]) for r in B.read_table(spark, root).collect()}


def test_upserts_replays_and_kills(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/k"
    assert B.upsert(_batch(spark, [(f"u{k}", k, "a") for k in range(40)] + [("u0", 99, "late")]), root, "url", "seq", 0, buckets=8)
    assert len(_table(spark, root)) == 40 and _table(spark, root)["u0"] == (99, "late")
    first = FS.read_manifest(spark, root)
    rows = [("u0", 50, "older"), ("u1", 200, "new"), ("x", 1, "x"), (None, 3, "none")]
    with monkeypatch.context() as m:
        m.setattr(B, "commit_manifest", _kill)
        with pytest.raises(Killed):
            B.upsert(_batch(spark, rows), root, "url", "seq", 1)
    assert len(_table(spark, root)) == 40
    assert B.upsert(_batch(spark, rows), root, "url", "seq", 1)
    want = _table(spark, root)
    assert want["u0"] == (99, "late") and want["u1"] == (200, "new") and want["x"] == (1, "x") and len(want) == 42
    assert not B.upsert(_batch(spark, [("u1", 900, "replayed")]), root, "url", "seq", 1)   # committed before
    assert _table(spark, root) == want
    second = FS.read_manifest(spark, root)
    same = [b for b in first["folders"] if first["folders"][b] == second["folders"][b]]
    assert 4 <= len(same) < 8 and second["buckets"] == 8            # untouched buckets stay where they are
    assert B.upsert(_batch(spark, []), root, "url", "seq", 2) and _table(spark, root) == want
    assert B.vacuum(spark, root, keep=1) == 1 and _table(spark, root) == want


def test_reading_the_table_takes_no_shuffle(spark, tmp_path):
    root = f"{tmp_path}/k"
    B.upsert(_batch(spark, [(f"u{k}", k, "a") for k in range(20)]), root, "url", "seq", 0, buckets=4)
    plan = B.read_table(spark, root).where(F.col("seq") > 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_a_batch_is_made_once_for_an_upsert(spark, tmp_path):
    """the rows of a batch were made twice, for its buckets and for the merge."""
    from pyspark.sql import functions as F
    from rankweave.sources.bucket_table import read_table, upsert
    made = spark.sparkContext.accumulator(0)

    def name(k):
        made.add(1)
        return f"n{k}"

    batch = spark.range(40).select(F.col("id").alias("seq"), F.concat(F.lit("u"), F.col("id") % 30).alias("url"),
                                   F.udf(name, "string")("id").alias("name"))
    assert upsert(batch, str(tmp_path / "t"), "url", "seq", 0)
    assert made.value == 40 and read_table(spark, str(tmp_path / "t")).count() == 30
