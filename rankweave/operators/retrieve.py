"""Retrieval strategies (F1-F5) over a whole table of understood queries.

Every strategy is: exact vector top-``depth`` (E6, bounded shuffle) -> join the
query columns by ``query_id`` -> a pair-row score expression -> per-query
top-k. Substring tests only ever run on those bounded pair rows.

Scores are rounded to 6 decimals before ranking; ties fall back to the
previous order (vector rank) and then to ``item_id``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query_text import lit_array
from ..functions.urls import WS_CLASS
from .knn import Prepared, knn_topk
from .topk import topk_per_group

QUERY_COLS = ("query_id", "q_raw_lower", "q_clean", "q_lower", "q_duration", "skills", "roles",
              "tag_prefs", "expanded_lower", "boost_terms", "boost_tokens", "q_words",
              "fb_skills", "fb_roles")

def name_l() -> Column:
    return F.lower(F.col("name"))


def desc_l() -> Column:
    return F.lower(F.coalesce(F.col("description"), F.lit("")))


def _has(text: Column, term: Column) -> Column:
    return F.contains(text, term)


def sum_over(arr: Column, fn) -> Column:
    """Sum of ``fn(element)`` over an array column (0 for an empty array)."""
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + fn(x))


def whitespace_words(text: Column) -> Column:
    """Distinct ``str.split()`` words of a text."""
    return F.array_distinct(F.filter(F.split(text, f"{WS_CLASS}+"), lambda w: w != ""))


HYBRID_DEPTH, BOOSTED_DEPTH = 150, 100  # vector candidates of F4 and F3


class Pool(NamedTuple):
    """Candidates (query_id, item_id, sim, sem_rank) of every query down to ``depth``."""
    hits: DataFrame
    depth: int


# Candidates are scored and ranked as narrow rows. The texts that scores read are made once for each item and query;
# the other columns are joined to what is left after ranking (``with_items``, ``with_queries``), by the id and a hash
# of the row, as ids may repeat.

def _rest(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c not in (key, "vec", "qvec", "label")]


def scoring_items(items: DataFrame) -> DataFrame:
    """What scores read of an item: its texts in lower case, and ``_irow`` to find the rest of it."""
    return items.select("item_id", "vec", name_l().alias("_name"), desc_l().alias("_desc"), "duration", "test_type", "remote_support",
                        F.xxhash64(*_rest(items, "item_id")).alias("_irow"))


def scoring_queries(uq: DataFrame, stopwords) -> DataFrame:
    """What scores read of a query, with the parts of them that depend on the query alone, and ``_qrow`` to find the rest of it."""
    words = F.array_except(whitespace_words(F.col("expanded_lower")), lit_array(stopwords))
    phrases = F.filter("skills", lambda s: _has(F.col("expanded_lower"), s))
    cols = [c for c in ("q_lower", "q_duration", "skills", "roles", "tag_prefs", "fb_skills", "fb_roles") if c in uq.columns]
    return uq.select("query_id", *cols, phrases.alias("_phrases"), words.alias("_words"),
                     F.xxhash64(*[c for c in QUERY_COLS if c in uq.columns]).alias("_qrow"))


def with_items(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """The item columns (but vectors) of ranked rows that have ``_irow``."""
    rest = _rest(items, "item_id")
    rows = items.select("item_id", F.xxhash64(*rest).alias("_irow"), *rest).dropDuplicates(["item_id", "_irow"])
    return ranked.join(rows, ["item_id", "_irow"], "inner").drop("_irow")


def with_queries(ranked: DataFrame, uq: DataFrame) -> DataFrame:
    """The query columns of ranked rows that have ``_qrow``."""
    cols = [c for c in QUERY_COLS if c in uq.columns]
    rows = uq.select(*cols, F.xxhash64(*cols).alias("_qrow")).dropDuplicates(["query_id", "_qrow"])
    return ranked.join(rows, ["query_id", "_qrow"], "inner").drop("_qrow")


NARROW = ("query_id", "item_id", "_qrow", "_irow", "sim", "sem_rank", "keyword_score", "hybrid_score")


def candidates(uq: DataFrame, items: DataFrame, depth: int, qvec: str = "qvec",
               pool: Pool | None = None) -> DataFrame:
    """Vector top-``depth`` per query with the query columns attached.

    ``pool`` is an already computed candidate table (see ``candidate_pool``): the
    top-``depth`` is then a prefix of it under the same ordering, so several
    strategies share one k-NN scan. A pool that isn't deep enough is an error.
    """
    cols = [c for c in QUERY_COLS if c in uq.columns]
    if pool is None:
        hits = knn_topk(uq.select("query_id", qvec), items, depth, qvec=qvec)
        return hits.join(uq.select(*cols), "query_id", "inner")
    if depth > pool.depth:
        raise ValueError(f"the shared pool holds {pool.depth} candidates a query; {depth} are asked for")
    hits = pool.hits.where(F.col("sem_rank") <= depth)
    payload = items.select(*[c for c in items.columns if c not in ("vec", "label")])
    return hits.join(payload, "item_id", "inner").join(uq.select(*cols), "query_id", "inner")


def candidate_pool(uq: DataFrame, items: DataFrame, depth: int = HYBRID_DEPTH, qvec: str = "qvec",
                   prepared: Prepared | None = None) -> Pool:
    """One exact k-NN scan at the largest depth that the strategies need. Only ids, scores and ranks are
    written to the shared checkpoint folder; each strategy joins the columns it reads."""
    from ..session import cut_lineage
    ids = items.select("item_id", "vec")
    return Pool(cut_lineage(knn_topk(uq.select("query_id", qvec), ids, depth, qvec=qvec, prepared=prepared)), depth)


def pool_depth(k: int) -> int:
    """Depth that covers hybrid (F4), boosted (F3), basic (3k) and semantic/keyword (2k) retrieval of k."""
    return max(HYBRID_DEPTH, BOOSTED_DEPTH, 3 * k)


def dedupe_by_url(df: DataFrame, order: list) -> DataFrame:
    """Keep the best row per (query, url) under ``order``."""
    w = Window.partitionBy("query_id", "url").orderBy(*order)
    return df.withColumn("_u", F.row_number().over(w)).where(F.col("_u") == 1).drop("_u")


def retrieve_basic(uq: DataFrame, items: DataFrame, k: int = 20,
                   max_duration: int | None = None, pool: Pool | None = None) -> DataFrame:
    """F1: top 3k by vector, post-filter duration, D7 term boosts (+0.15 name / +0.05 description)."""
    c = candidates(uq, items, 3 * k, pool=pool)
    if max_duration is not None:
        c = c.where(F.coalesce(F.col("duration"), F.lit(0)) <= max_duration)
    return topk_per_group(basic_scored(c), ["query_id"], BASIC_ORDER(), k)


def BASIC_ORDER() -> list:
    return [F.col("score").desc(), F.col("sem_rank").asc(), F.col("item_id").asc()]


def basic_scored(c: DataFrame) -> DataFrame:
    """F1 scoring of candidate rows: D7 term boosts (+0.15 name / +0.05 description)."""
    boost = sum_over(F.col("boost_terms"),
                     lambda t: F.when(_has(name_l(), t), 0.15).when(_has(desc_l(), t), 0.05).otherwise(0.0))
    return c.withColumn("boost", F.round(boost, 6)).withColumn("score", F.round(F.col("sim") + boost, 6))


def retrieve_semantic(uq: DataFrame, items: DataFrame, k: int = 10,
                      pool: Pool | None = None) -> DataFrame:
    """top 2k by vector, de-duplicated by URL, first k."""
    c = candidates(uq, items, 2 * k, pool=pool)
    c = dedupe_by_url(c, [F.col("sem_rank").asc()]).withColumn("score", F.col("sim"))
    return topk_per_group(c, ["query_id"], [F.col("sem_rank").asc()], k)


def retrieve_boosted(uq: DataFrame, items: DataFrame, k: int = 10, depth: int = BOOSTED_DEPTH,
                     pool: Pool | None = None) -> DataFrame:
    """top ``depth`` by vector, de-dup by URL; D8 token boosts (+0.3 / +0.1) and
    +0.15 for every query word longer than 3 characters found in the name."""
    c = dedupe_by_url(candidates(uq, items, depth, pool=pool), [F.col("sem_rank").asc()])
    boost = (sum_over(F.col("boost_tokens"),
                      lambda t: F.when(_has(name_l(), t), 0.3).when(_has(desc_l(), t), 0.1).otherwise(0.0))
             + sum_over(F.col("q_words"),
                        lambda w: F.when((F.length(w) > 3) & _has(name_l(), w), 0.15).otherwise(0.0)))
    scored = c.withColumn("boost", F.round(boost, 6)) \
        .withColumn("score", F.round(F.col("sim") + boost, 6))
    return topk_per_group(scored, ["query_id"],
                          [F.col("score").desc(), F.col("sem_rank").asc(), F.col("item_id").asc()], k)


def hybrid_keyword_score() -> Column:
    """F4 keyword score of a pair row of ``scoring_items`` and ``scoring_queries``."""
    name, desc = F.col("_name"), F.col("_desc")
    skill = sum_over(F.col("skills"), lambda s: F.when(_has(name, s), 0.40).when(_has(desc, s), 0.10).otherwise(0.0))
    role = sum_over(F.col("roles"), lambda r: F.when(_has(name, r), 0.30).when(_has(desc, r), 0.10).otherwise(0.0))
    phrase = sum_over(F.col("_phrases"), lambda s: F.when(_has(name, s), 0.20).otherwise(0.0))
    tags = sum_over(F.col("tag_prefs"),
                    lambda t: F.when(F.array_contains(F.col("test_type"), t), 0.20).otherwise(0.0))
    common = F.size(F.array_intersect(F.col("_words"), whitespace_words(name)))
    return skill + role + phrase + tags + common * 0.15


def hybrid_scores(uq: DataFrame, items: DataFrame, stopwords, k: int = 100, depth: int = HYBRID_DEPTH,
                  pool: Pool | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """F4 as narrow rows (``NARROW``, ``hybrid_rank``); ``also`` names scores of pair rows to be made on the way.

    Names with a leading ``_`` are steps that the scores after them read; they aren't kept.
    """
    slim = scoring_items(items)
    asked = scoring_queries(uq, stopwords)
    if pool is None:
        hits = knn_topk(uq.select("query_id", "qvec"), slim, depth)
    else:
        if depth > pool.depth:
            raise ValueError(f"the shared pool holds {pool.depth} candidates a query; {depth} are asked for")
        hits = pool.hits.where(F.col("sem_rank") <= depth).join(slim.drop("vec"), "item_id", "inner").repartition("query_id")
    # scores with lambdas get a column of their own: two columns with the same lambda are computed twice
    scored = hits.join(asked, "query_id", "inner").withColumn("_kw", hybrid_keyword_score()) \
        .withColumn("keyword_score", F.round("_kw", 6)).withColumn("hybrid_score", F.round(F.col("sim") + F.col("_kw"), 6))
    for name, score in (also or {}).items():
        scored = scored.withColumn(name, score)
    return topk_per_group(scored.select(*NARROW, *[name for name in also or {} if not name.startswith("_")]), ["query_id"],
                          [F.col("hybrid_score").desc(), F.col("sem_rank").asc(), F.col("item_id").asc()],
                          k, rank_col="hybrid_rank")


def hybrid_retrieve(uq: DataFrame, items: DataFrame, stopwords, k: int = 100,
                    depth: int = HYBRID_DEPTH, pool: Pool | None = None) -> DataFrame:
    """top ``depth`` by vector of the expanded query; keyword score; top k by
    ``hybrid_score`` = similarity + keyword score (numbered ``hybrid_rank``)."""
    return with_queries(with_items(hybrid_scores(uq, items, stopwords, k, depth, pool), items), uq)


def keyword_retrieve(uq: DataFrame, items: DataFrame, k: int = 20,
                     pool: Pool | None = None) -> DataFrame:
    """over the top 2k by vector, independent skill/role boosts; rows scoring 0 dropped."""
    c = candidates(uq, items, 2 * k, pool=pool)
    raw_l = F.col("q_raw_lower")
    kw = (sum_over(F.col("skills"), lambda s: F.when(_has(name_l(), s), 0.30).otherwise(0.0))
          + sum_over(F.col("roles"), lambda r: F.when(_has(name_l(), r), 0.25).otherwise(0.0))
          + sum_over(F.col("skills"), lambda s: F.when(_has(desc_l(), s), 0.10).otherwise(0.0))
          + sum_over(F.col("skills"),
                     lambda s: F.when(_has(raw_l, s) & _has(name_l(), s), 0.15).otherwise(0.0)))
    scored = c.withColumn("keyword_score", F.round(kw, 6)).where(F.col("keyword_score") > 0) \
        .withColumn("score", F.col("keyword_score"))
    return topk_per_group(scored, ["query_id"],
                          [F.col("score").desc(), F.col("sem_rank").asc(), F.col("item_id").asc()], k)
