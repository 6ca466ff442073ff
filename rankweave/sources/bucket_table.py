"""A keyed table in hash buckets that a batch upserts into, copy on write.

A manifest names one folder for each bucket. A batch reads the buckets of its keys, merges, writes these
buckets anew and commits a manifest that names them instead; all others stay where they are. A bucket holds one
row of each key, so reading the table is reading its folders: no shuffle, no merge.

A manifest remembers the last batch, so a batch that is replayed after its commit changes nothing, and one that died
before it starts from the state before. Folders that no manifest names are left-overs, see ``vacuum``.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.curate import dedupe_by_url
from ..session import written
from .files import _fs, commit_manifest, read_manifest

BUCKETS = 64


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def upsert(batch: DataFrame, root: str, key: str, seq: str, batch_id: int, buckets: int = BUCKETS) -> bool:
    """Merge a batch: of each key the row with the largest ``seq`` stays. False if the batch had been committed.

    ``buckets`` counts for a new table; one that exists keeps its number.
    """
    spark = batch.sparkSession
    previous = read_manifest(spark, root)
    state = previous or {"buckets": buckets, "folders": {}, "last_batch": -1}
    if batch_id <= state["last_batch"]:
        return False
    n = state["buckets"]
    new = written(dedupe_by_url(batch, seq, "last", key), "upsert")  # read twice: for its buckets and for the merge
    touched = sorted(r["b"] for r in new.select(bucket_of(key, n).alias("b")).distinct().collect())  # n rows at most
    folders = dict(state["folders"])
    if touched:
        old = [folders[str(b)] for b in touched if str(b) in folders]
        merged = new.unionByName(spark.read.schema(new.schema).parquet(*old)) if old else new
        path = f"{root}/data-{uuid4().hex}"
        merged = dedupe_by_url(merged, seq, "last", key).withColumn("_bucket", bucket_of(key, n))
        merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(path)
        folders.update({str(b): f"{path}/_bucket={b}" for b in touched})
    commit_manifest(spark, root, previous, {"buckets": n, "folders": folders, "last_batch": batch_id, "schema": new.schema.json()})
    return True


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of its last (or a given) version."""
    manifest = read_manifest(spark, root, version)
    if manifest is None:
        raise FileNotFoundError(f"nothing was committed under {root}")
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    folders = sorted(manifest["folders"].values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete data folders that none of the last ``keep`` versions names; how many went.

    Not to be run beside a writer: its uncommitted folder is one that no version names.
    """
    last = read_manifest(spark, root)
    if last is None:
        return 0
    named = set()
    for version in range(max(1, last["version"] - keep + 1), last["version"] + 1):
        manifest = read_manifest(spark, root, version)
        paths = [*manifest.get("folders", {}).values(), *([manifest["path"]] if "path" in manifest else [])]
        named |= {part for p in paths for part in p.split("/") if part.startswith("data-")}
    fs, folder = _fs(spark, root)
    gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
