"""Spark session construction and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants: adaptive execution (runtime coalescing, skew-join
# splitting, broadcast conversion), Arrow for the few Python batch operators,
# UTC timestamps, and no web UI.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "rankweave", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so on a
    cluster the submitter's settings win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) do we pick a scratch folder and record it in the session. Without
    it, a cluster's executors and driver would each write to folders of their own,
    so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rankweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_done(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results have been written, which Spark keeps until the driver collects garbage.

    A driver with little to do rarely does so on its own, and the files of all steps would add up.
    """
    gc.collect()  # frames that Python holds in cycles hold their plans
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table of their own in the shared folder: a lineage cut whose columns can be read alone."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Executors don't share the driver's folders or its import path; functions that run in
    Python there are found in the archive that is sent.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rankweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rankweave-zip-"), "rankweave_src.zip")
    with zipfile.ZipFile(path, "w") as z:  # read on the driver only, by addPyFile
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._rankweave_shipped = True
