"""K2: resumable page ingestion -- a file-source stream of raw pages upserted into the catalogue.

Every micro-batch extracts the item fields from its pages (B6-B10) and merges them into a table in hash buckets of
the URL (``sources.bucket_table``): of each URL the row of the latest page stays (C9 keep-last). Only the
buckets of the batch's URLs are rewritten, a replayed batch changes nothing, and reading the catalogue takes no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.bucket_table import BUCKETS, read_table, upsert

TASKS_PER_CORE = 4      # tasks over which a batch's pages are dealt
PAGE_SCHEMA = "page_id long, url string, html string"


def extract_items(pages: DataFrame, seq: str = "page_id") -> DataFrame:
    text = T.page_text(F.col("html"))
    remote, adaptive = T.extract_flags(text)
    return pages.select(
        F.col(seq).alias("seq"), "url",
        T.extract_name(F.col("html")).alias("name"),
        T.extract_description(F.col("html")).alias("description"),
        T.extract_duration(text).alias("duration"),
        remote.alias("remote_support"), adaptive.alias("adaptive_support"),
        T.classify_tags(text).alias("test_type"))


def start_ingest_stream(spark: SparkSession, pages_dir: str, root: str, checkpoint: str,
                        max_files_per_trigger: int | None = 1, available_now: bool = True, buckets: int = BUCKETS):
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(pages_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)  # a batch may be one file
        upsert(extract_items(dealt), root, "url", "seq", batch_id, buckets)

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The current catalogue: one row per URL."""
    return read_table(spark, root)
