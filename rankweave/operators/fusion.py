"""fusion of several ranked lists by weighted top-2 score and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import topk_per_group

PAYLOAD = ("alternate_urls", "name", "description", "duration", "remote_support",
           "adaptive_support", "test_type")
RRF_K = 60
TOP_WEIGHT, SECOND_WEIGHT = 0.7, 0.3
SCORE_WEIGHT, RRF_WEIGHT = 0.7, 0.3


def fuse_rankings(lists: list[tuple[str, DataFrame, str]], k: int = 10) -> DataFrame:
    """Fuse ranked lists given as (name, ranked df, score column), in priority order.

    Per (query, url): ensemble = 0.7 x best score + 0.3 x second best (or the
    only score); rrf = sum of 1 / (60 + rank) over the lists; final =
    0.7 x ensemble + 0.3 x rrf. The item payload and the tie-break come from
    the first list (in the given order) that contains the URL.

    Every (query, url) group holds at most one row per list and list entry,
    so the grouped ``collect_list`` is bounded by the lists' depth.
    """
    union = None
    for idx, (_, df, score) in enumerate(lists):
        payload = [c for c in PAYLOAD if c in df.columns]
        part = df.select("query_id", "url", "item_id", "rank",
                         F.col(score).cast("double").alias("score"), F.lit(idx).alias("src"),
                         F.struct(*payload).alias("_p"))
        union = part if union is None else union.unionByName(part)
    g = union.groupBy("query_id", "url").agg(
        F.sort_array(F.collect_list("score"), asc=False).alias("_scores"),
        F.array_sort(F.collect_list(F.struct("src", "rank"))).alias("_ranks"),
        F.min(F.struct("src", "rank", "item_id")).alias("_first"),
        F.min_by("_p", F.struct("src", "rank")).alias("_p"))
    s = F.col("_scores")
    first, second = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(2))
    ens = F.when(F.size(s) >= 2, first * TOP_WEIGHT + second * SECOND_WEIGHT).otherwise(first)
    rrf = F.aggregate(F.col("_ranks"), F.lit(0.0).cast("double"),
                      lambda acc, r: acc + F.lit(1.0) / (F.lit(RRF_K) + r["rank"]))
    out = (g.withColumn("ensemble_score", ens).withColumn("rrf_score", rrf)
           .withColumn("final_score", F.col("ensemble_score") * SCORE_WEIGHT + F.col("rrf_score") * RRF_WEIGHT)
           .withColumn("item_id", F.col("_first")["item_id"])
           .withColumn("first_src", F.col("_first")["src"])
           .withColumn("first_rank", F.col("_first")["rank"])
           .withColumn("n_lists", F.size("_scores"))
           .select("*", "_p.*")
           .drop("_scores", "_ranks", "_first", "_p"))
    return topk_per_group(out, ["query_id"], [F.col("final_score").desc(), F.col("first_src").asc(),
                                              F.col("first_rank").asc(), F.col("item_id").asc()], k)


def ensemble(uq: DataFrame, items: DataFrame, lex, k: int = 10, pool=None) -> DataFrame:
    """F9 with the four strategies of the original, each 2k deep, in this order:
    hybrid + rules (F8), boosted (F3), basic (F1), keyword (F5). The four share one
    k-NN pool (computed here when not given)."""
    from ..plans.recommend import recommend
    from .retrieve import candidate_pool, keyword_retrieve, pool_depth, retrieve_basic, retrieve_boosted
    pool = pool if pool is not None else candidate_pool(uq, items, pool_depth(2 * k))
    lists = [
        ("advanced", recommend(uq, items, lex, k=2 * k, reranker="rules", understood=True, shared=pool, query_columns=False),
         "final_score"),
        ("boosted", retrieve_boosted(uq, items, k=2 * k, pool=pool), "score"),
        ("basic", retrieve_basic(uq, items, k=2 * k, pool=pool), "score"),
        ("keyword", keyword_retrieve(uq, items, k=2 * k, pool=pool), "score"),
    ]
    return fuse_rankings(lists, k)
