"""K1: continuous recommend -- a file-source stream of queries against a static catalogue.

The catalogue's vectors are written and grouped for the k-NN once, when the stream starts. Each micro-batch runs the batch recommend plan (F8) and is written to
``<out>/batch_id=<n>`` with overwrite, so a replayed batch (after a failure,
the checkpoint re-runs the last uncommitted batch) replaces its own output
and the sink stays exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import prepare_items
from ..operators.retrieve import candidate_pool
from ..operators.understand import understand_queries
from ..plans.recommend import recommend
from ..session import cut_lineage


def start_recommend_stream(spark: SparkSession, query_dir: str, query_schema, items: DataFrame, lex,
                           out_dir: str, checkpoint: str, k: int = 10, reranker: str = "rules",
                           max_files_per_trigger: int | None = None, available_now: bool = True):
    reader = spark.readStream.schema(query_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(query_dir)

    prepared = prepare_items(items)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        uq = cut_lineage(understand_queries(batch, lex))
        pool = candidate_pool(uq, items, prepared=prepared)
        ranked = recommend(uq, items, lex, k=k, reranker=reranker, understood=True, shared=pool, query_columns=False)
        cols = ["query_id", "rank", "item_id", "url", "final_score"]
        ranked.select(*cols).withColumn("rank", F.col("rank").cast("bigint")) \
            .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_stream_output(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir)
