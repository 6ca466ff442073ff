"""File sources and sinks.

Readers declare their schema (no inference at scale); writers never
overwrite the path that is being read (folders named by numbered manifests). All paths are ordinary Hadoop paths, so the same code reads and
writes local folders in tests and shared storage on a cluster.
"""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import py_strip, url_to_slug
from .splittable import read_csv, read_json_array

CATALOG_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("remote_support", T.StringType()),
    T.StructField("adaptive_support", T.StringType()),
    T.StructField("test_type", T.ArrayType(T.StringType())),
    T.StructField("alternate_urls", T.ArrayType(T.StringType())),
    T.StructField("entity_id", T.StringType()),
])
JUDGMENT_SCHEMA = "Query string, Assessment_url string"
QUERY_SCHEMA = "Query string"


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """A1: (Query, slug) set of relevant slugs per trimmed query text. One file is read by many tasks."""
    df = read_csv(spark, path, JUDGMENT_SCHEMA)
    return df.select(py_strip(F.col("Query")).alias("Query"),
                     url_to_slug(py_strip(F.col("Assessment_url"))).alias("slug")).distinct()


def read_queries(spark: SparkSession, path: str, dedupe: str = "ordered") -> DataFrame:
    """A2: unlabelled queries with a stable ``query_id`` (hash of the text). One file is read by many tasks.

    dedupe='ordered' keeps the first occurrence (by file, then place in it), 'unique' keeps
    one row per text, 'none' keeps every row; ``ordinal`` orders the rows of a file.
    """
    df = read_csv(spark, path, QUERY_SCHEMA).select("Query", "_file", F.col("_offset").alias("ordinal"), F.xxhash64("Query").alias("query_id"))
    if dedupe == "none":
        return df.drop("_file")
    if dedupe == "unique":
        return df.drop("_file").dropDuplicates(["Query"])
    # first occurrence per text, as a grouped min (combined map-side before the shuffle)
    first = df.groupBy("Query").agg(F.min_by(F.struct("ordinal", "query_id"), F.struct("_file", "ordinal")).alias("_f"))
    return first.select("Query", "_f.ordinal", "_f.query_id")


def read_catalog(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A3: catalogue items from JSON: arrays of objects with ``multiline``, else JSON lines. One file is read by many tasks."""
    if multiline:
        return read_json_array(spark, path, CATALOG_SCHEMA)
    return spark.read.schema(CATALOG_SCHEMA).json(path)


def write_catalog(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """A4: write the catalogue without the transient entity id."""
    out = df.drop("entity_id") if "entity_id" in df.columns else df
    out.write.mode(mode).format(fmt).save(path)
    return path


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A5: CSV with exactly the columns Query, Assessment_url, in that order; rows in rank order where
    the input has query_id and rank."""
    if {"query_id", "rank"} <= set(df.columns):
        df = df.orderBy("query_id", "rank")
    df.select("Query", "Assessment_url").write.mode(mode).option("header", True) \
        .option("escape", '"').csv(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version that this one was about to commit."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, or leave the one that is there; whether it was created.

    The text is written beside it and renamed without overwriting, so no reader sees half of it.
    """
    jvm, fs_conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), fs_conf).rename(draft, target, options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    return True


def _manifest(root: str, version: int) -> str:
    return f"{root}/_manifests/{version:012d}.json"


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the highest one; None if nothing was committed."""
    if version is None:
        fs, folder = _fs(spark, f"{root}/_manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)
        if version is None:
            return None
    fs, path = _fs(spark, _manifest(root, version))
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_manifest(spark: SparkSession, root: str, previous: dict | None, content: dict) -> dict:
    """Commit ``content`` as the version after ``previous``; ConcurrentWrite if that version exists."""
    version = (previous["version"] if previous else 0) + 1
    manifest = {"version": version, **content}
    if not put_if_absent(spark, _manifest(root, version), json.dumps(manifest)):
        raise ConcurrentWrite(f"version {version} of {root} was committed by another writer")
    return manifest


def current_version(spark: SparkSession, root: str) -> int | None:
    manifest = read_manifest(spark, root)
    return manifest["version"] if manifest else None


def write_versioned(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write to a folder of this attempt's own, then commit the numbered manifest that names it.

    The previous version stays readable (it is the backup) and the path that is being read is never overwritten.
    A writer that dies before the commit leaves a folder that no manifest names, and the next one starts anew.
    """
    spark = df.sparkSession
    previous = read_manifest(spark, root)
    path = f"{root}/data-{uuid4().hex}"
    df.write.mode("errorifexists").format(fmt).save(path)
    commit_manifest(spark, root, previous, {"path": path})
    return path


def read_current(spark: SparkSession, root: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The current version of a table, or a given one."""
    manifest = read_manifest(spark, root, version)
    if manifest is None:
        raise FileNotFoundError(f"no version written under {root}")
    return spark.read.format(fmt).load(manifest["path"])


def materialize(df_builder, spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """Load the table at ``path`` when present, else build it, write it and load it.

    ``force`` rebuilds into a new version instead of deleting what readers may use.
    """
    if not force and current_version(spark, path) is not None:
        return read_current(spark, path)
    write_versioned(df_builder(), path)
    return read_current(spark, path)


def incremental_catalog(new: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Rows of ``new`` still to enrich: those whose URL has no non-empty description in ``done``."""
    enriched = done.where(F.coalesce(py_strip(F.col("description")), F.lit("")) != "").select(url).distinct()
    return new.join(enriched, url, "left_anti")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages (page_id, url, html)."""
    return spark.read.schema("page_id long, url string, html string").parquet(path)
