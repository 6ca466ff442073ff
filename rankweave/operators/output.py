"""Response formatting, batch predictions and result summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three mis-decoded sequences repaired in descriptions.
MOJIBAKE = (("â€¦", "…"), ("â€\"", "—"), ("â€™", "'"))
MIN_RESULTS = 5
MAX_RESULTS = 10


def fix_mojibake(text: Column) -> Column:
    """Three literal replacements."""
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def response_items(ranked: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    """F14 item rows: the first k ranked rows with the response defaults applied."""
    return ranked.where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "url",
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("adaptive_support", F.lit("No")).alias("adaptive_support"),
        fix_mojibake(F.coalesce("description", F.lit(""))).alias("description"),
        F.coalesce("duration", F.lit(0)).cast("int").alias("duration"),
        F.coalesce("remote_support", F.lit("No")).alias("remote_support"),
        F.coalesce("test_type", F.array().cast("array<string>")).alias("test_type"))


def format_response(ranked: DataFrame, queries: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    """one response per query: status ('ok', 'too_few' below 5 items, 'not_found'
    for none) and the ordered list of at most k items (bounded by k)."""
    items = response_items(ranked, k)
    packed = items.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in items.columns if c != "query_id"])))
        .alias("recommended_assessments"))
    out = queries.select("query_id").join(packed, "query_id", "left")
    n = F.coalesce(F.size("recommended_assessments"), F.lit(0))
    return out.select("query_id",
                      F.when(n == 0, "not_found").when(n < MIN_RESULTS, "too_few").otherwise("ok").alias("status"),
                      n.cast("bigint").alias("n_results"),
                      F.coalesce("recommended_assessments",
                                 F.array().cast(packed.schema["recommended_assessments"].dataType))
                      .alias("recommended_assessments"))


def batch_predictions(ranked: DataFrame, queries: DataFrame, text: str = "query",
                      k: int = MAX_RESULTS) -> DataFrame:
    """(Query, Assessment_url) rows in rank order for every query."""
    return (ranked.where(F.col("rank") <= k)
            .join(queries.select("query_id", F.col(text).alias("Query")), "query_id", "inner")
            .select("query_id", "Query", F.col("url").alias("Assessment_url"),
                    F.col("rank").cast("bigint").alias("rank")))


def prediction_stats(pred: DataFrame) -> DataFrame:
    """Total rows, distinct queries and the mean per query."""
    return pred.agg(F.count(F.lit(1)).alias("n_predictions"),
                    F.countDistinct("Query").alias("n_queries")) \
        .withColumn("mean_per_query", F.col("n_predictions") / F.col("n_queries"))


def validate_predictions(pred: DataFrame, expected_queries: DataFrame, text: str = "query") -> DataFrame:
    """(check, passed, detail) rows: exact columns in order, non-empty, every URL
    starts with 'http', every expected query covered."""
    cols_ok = list(pred.columns[:2]) == ["Query", "Assessment_url"]
    stats = pred.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(~F.coalesce(F.col("Assessment_url"), F.lit("")).startswith("http")).alias("bad"))
    missing = expected_queries.select(F.col(text).alias("Query")).distinct() \
        .join(pred.select("Query").distinct(), "Query", "left_anti").agg(F.count(F.lit(1)).alias("m"))
    checks = stats.select(F.inline(F.array(
        F.struct(F.lit("columns").alias("check"), F.lit(cols_ok).alias("passed"),
                 F.lit(",".join(pred.columns[:2])).alias("detail")),
        F.struct(F.lit("non_empty").alias("check"), (F.col("n") > 0).alias("passed"),
                 F.col("n").cast("string").alias("detail")),
        F.struct(F.lit("urls_http").alias("check"), (F.col("bad") == 0).alias("passed"),
                 F.col("bad").cast("string").alias("detail")))))
    cover = missing.select(F.lit("queries_covered").alias("check"), (F.col("m") == 0).alias("passed"),
                           F.col("m").cast("string").alias("detail"))
    return checks.unionByName(cover)


def result_summary(ranked: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    """I4: per query average positive duration (null if none), remote and adaptive counts."""
    r = ranked.where(F.col("rank") <= k)
    d = F.coalesce(F.col("duration"), F.lit(0))
    return r.groupBy("query_id").agg(
        F.avg(F.when(d > 0, d)).alias("avg_duration"),
        F.count_if(F.col("remote_support") == "Yes").alias("n_remote"),
        F.count_if(F.col("adaptive_support") == "Yes").alias("n_adaptive"),
        F.count(F.lit(1)).alias("n_results"))


def result_table(ranked: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    """Display rows (rank, name, duration, joined categories or 'Unknown', flags, URL)."""
    tags = F.coalesce(F.col("test_type"), F.array().cast("array<string>"))
    return ranked.where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("bigint").alias("Rank"), F.col("name").alias("Name"),
        F.coalesce("duration", F.lit(0)).cast("int").alias("Duration"),
        F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(F.lit("Unknown")).alias("Test_Type"),
        F.col("remote_support").alias("Remote_Support"), F.col("adaptive_support").alias("Adaptive"),
        F.col("url").alias("URL"))
