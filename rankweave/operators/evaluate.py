"""Evaluation and analysis.

Relevance is by slug: a judged URL is relevant to its query; a ranked item
hits when any of its variant slugs (C4) equals a relevant slug. Judgments are classes (``relevance``):
work starts from the ranked rows, at most k a query, which look their slugs up in their query's class. Several
rankings are one table: a bit mask tells which of them hold a (query, slug). Per-query detail is returned as
rows, not arrays.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query_text import contains_any
from ..functions.urls import VIEW_MARKER, py_strip, url_variants
from .relevance import Relevance, as_relevance, class_slugs, counts_for, each_with_each, judged_queries, missed_by, slug_of

MAX_RANKINGS = 62     # bits of a mask


def ranked_slugs(ranked: DataFrame, k: int, rank: str = "rank", marker: str = VIEW_MARKER, mask=None) -> DataFrame:
    """Distinct (query_id, slug) over the variant slugs of the first k ranked items, and the masks of their rankings."""
    alts = F.col("alternate_urls") if "alternate_urls" in ranked.columns else None
    variants = F.explode(url_variants(F.col("url"), alts, marker)).alias("slug")
    rows = ranked.where(F.col(rank) <= k).select("query_id", (F.lit(1) if mask is None else mask).cast("long").alias("mask"), variants)
    return rows.groupBy("query_id", "slug").agg(F.bit_or("mask").alias("mask"))


def recall_at_k(ranked: DataFrame, judgments: DataFrame | Relevance, k: int = 10, rank: str = "rank",
                by: dict | None = None) -> DataFrame:
    """H1: per query |relevant slugs in top k| / |relevant slugs|, for every query with a relevant slug.

    ``has_results`` tells whether the ranking produced any row for the query
    (used by the 'skip' error policy of H2). ``by`` maps one column that exists only on the ranking side (a
    strategy, a depth) to its known values; every query is evaluated once for each of them.
    """
    rel = as_relevance(judgments)
    (name, values), = (by or {None: [None]}).items()
    if len(values) > MAX_RANKINGS:
        raise ValueError(f"at most {MAX_RANKINGS} rankings can be compared at once")
    mask = None
    if by:
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        ranked = ranked.withColumn("_place", place.cast("int")).where("_place > 0")
        mask = F.expr("shiftleft(1L, _place - 1)")
    slugs = class_slugs(rel)
    judged = judged_queries(rel, slugs)
    found = judged.join(ranked_slugs(ranked, k, rank, mask=mask), "query_id", "left").join(
        slugs.withColumn("_known", F.lit(True)), ["class_id", "slug"], "left")
    hit = F.coalesce(F.col("_known"), F.lit(False)) & counts_for(F.col("only"))
    bit = lambda i: F.expr(f"shiftright(mask, {i}) & 1")
    per = found.groupBy("query_id", "n_relevant").agg(
        F.bit_or("mask").alias("_seen"), *[F.coalesce(F.sum(F.when(hit, bit(i))), F.lit(0)).alias(f"_h{i}") for i in range(len(values))])
    seen = lambda i: F.coalesce(F.expr(f"shiftright(_seen, {i}) & 1") == 1, F.lit(False))
    rows = F.array(*[F.struct(*([F.lit(v).alias(name)] if by else []), F.col(f"_h{i}").alias("n_hits"), seen(i).alias("has_results"))
                     for i, v in enumerate(values)])
    return per.select("query_id", "n_relevant", F.inline(rows)).withColumn("recall", F.col("n_hits") / F.col("n_relevant"))


def mean_recall(per_query: DataFrame, policy: str = "zero", by: Sequence[str] = ()) -> DataFrame:
    """H2: unweighted mean over queries; policy 'zero' counts failed queries as 0,
    'skip' leaves them out."""
    df = per_query if policy == "zero" else per_query.where(F.col("has_results"))
    agg = [F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("mean_recall")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def recall_stats(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """H3: mean, min, max and threshold counts of per-query recall."""
    r = F.col("recall")
    agg = [F.count(F.lit(1)).alias("n_queries"), F.avg(r).alias("mean_recall"),
           F.min(r).alias("min_recall"), F.max(r).alias("max_recall"),
           F.count_if(r == 0).alias("n_zero"), F.count_if(r == 1).alias("n_full"),
           F.count_if(r < 0.5).alias("n_below_50"), F.count_if(r < 0.3).alias("n_below_30")]
    return per_query.groupBy(*by).agg(*agg) if by else per_query.agg(*agg)


def compare_strategies(rankings: dict, judgments: DataFrame | Relevance, k: int = 10,
                       baseline: str | None = None) -> DataFrame:
    """H4: mean Recall@k per strategy, its rank, the best flag and the gain over a baseline.

    ``rankings`` maps strategy name -> ranked DataFrame (query_id, url,
    alternate_urls, rank). The strategy table has one row per strategy, so the
    final ranking window over it is tiny.
    """
    union = None
    for name, df in rankings.items():
        part = df.select("query_id", "url", "alternate_urls", "rank").withColumn("strategy", F.lit(name))
        union = part if union is None else union.unionByName(part)
    per = recall_at_k(union, judgments, k, by={"strategy": list(rankings)})
    means = mean_recall(per, "zero", by=["strategy"])
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("mean_recall").desc(), F.col("strategy"))
    out = means.withColumn("position", F.row_number().over(w).cast("bigint"))
    out = out.withColumn("is_best", F.col("position") == 1)
    if baseline is not None:
        base = F.max(F.when(F.col("strategy") == baseline, F.col("mean_recall"))).over(
            Window.partitionBy(F.lit(0)))
        out = out.withColumn("gain_over_baseline", F.col("mean_recall") - base)
    return out


def depth_lists(scored: DataFrame, depths: Sequence[int], eval_k: int) -> DataFrame:
    """(depth, query_id, rank, item columns): the first min(depth, eval_k) of the rows with sem_rank <= 3 * depth, each depth.

    One ordered fold over each query's candidates (at most 3 * max(depths) of them): going down the vector ranks, the
    best ``eval_k`` so far are kept, and given out where a depth's candidates end.
    """
    entry = F.struct((-F.col("score")).alias("minus"), F.col("sem_rank"), F.col("item_id"), F.col("url"), F.col("alternate_urls"))
    kind = F.struct(*[F.lit(None).cast(scored.schema[c].dataType).alias(a) for a, c in (
        ("minus", "score"), ("sem_rank", "sem_rank"), ("item_id", "item_id"), ("url", "url"), ("alternate_urls", "alternate_urls"))])
    empty = F.filter(F.array(kind), lambda x: F.lit(False))
    per = scored.groupBy("query_id").agg(F.collect_list(entry).alias("_rows"))
    ordered = sorted(set(depths))
    steps = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(3 * before).alias("after"), F.lit(3 * d).alias("upto"))
                      for before, d in zip([0, *ordered], ordered)])

    def step(acc, s):
        more = F.filter(F.col("_rows"), lambda r: (r["sem_rank"] > s["after"]) & (r["sem_rank"] <= s["upto"]))
        top = F.slice(F.array_sort(F.concat(acc["top"], more)), 1, eval_k)
        given = F.struct(s["depth"].alias("depth"), F.slice(top, 1, F.least(s["depth"], F.lit(eval_k))).alias("rows"))
        return F.struct(top.alias("top"), F.concat(acc["out"], F.array(given)).alias("out"))

    none = F.filter(F.array(F.struct(F.lit(0).alias("depth"), empty.alias("rows"))), lambda x: F.lit(False))
    lists = F.aggregate(steps, F.struct(empty.alias("top"), none.alias("out")), step)["out"]
    return per.select("query_id", F.inline(lists)).select("query_id", "depth", F.posexplode("rows").alias("_p", "_r")).select(
        "depth", "query_id", (F.col("_p") + 1).alias("rank"), "_r.item_id", "_r.url", "_r.alternate_urls")


def sweep_depth(uq: DataFrame, items: DataFrame, judgments: DataFrame | Relevance, depths, eval_k: int = 10,
                pool=None) -> DataFrame:
    """H5: mean Recall@eval_k of the basic retriever (F1) for each retrieval depth, in one job.

    The vector pool is retrieved once at the largest depth; depth d keeps the
    candidates with vector rank <= 3d (F1's pool), re-ranks them and keeps the
    first min(d, eval_k). Pool rows are read once for all depths.
    """
    from .retrieve import basic_scored, candidates
    depths = list(depths)
    ranked = depth_lists(basic_scored(candidates(uq, items, 3 * max(depths), pool=pool)), depths, eval_k)
    per = recall_at_k(ranked, judgments, eval_k, by={"depth": depths})
    return mean_recall(per, "zero", by=["depth"])


def item_names(catalog: DataFrame) -> DataFrame:
    """(_u, name): the name of each primary or alternate URL (of several items the one with the smallest id)."""
    urls = F.concat(F.array("url"), F.coalesce("alternate_urls", F.array().cast("array<string>")))
    return catalog.select(F.explode(urls).alias("_u"), "name", "item_id").groupBy("_u").agg(F.min_by("name", F.col("item_id")).alias("name"))


def miss_analysis(ranked: DataFrame, judgments: DataFrame | Relevance, catalog: DataFrame, k: int = 10,
                  rank: str = "rank") -> DataFrame:
    """H6: one row per judged URL whose slug was missed, with the item name looked up
    by exact URL (primary or alternate) in the catalogue, else 'Unknown'.

    The report lists judgments, so it has as many rows as they are; for counts see ``missed_totals``.
    """
    rel = as_relevance(judgments)
    per = recall_at_k(ranked, rel, k, rank=rank).select("query_id", "recall", "n_hits", "n_relevant")
    # what a query found (k items at most) goes to the query and a member's name to the member, so the pairs aren't shuffled
    got = ranked_slugs(ranked, k, rank).groupBy("query_id").agg(F.collect_set("slug").alias("_got"))
    asked = rel.queries.join(per, "query_id").join(got, "query_id", "left")
    members = rel.members.withColumn("_u", py_strip(F.col("url"))).join(item_names(catalog), "_u", "left").select(
        "class_id", "member", F.col("url").alias("Assessment_url"), slug_of(F.col("url")).alias("slug"),
        F.coalesce("name", F.lit("Unknown")).alias("name"))
    found = F.coalesce(F.array_contains("_got", F.col("slug")), F.lit(False))
    return each_with_each(asked, members).where(counts_for(F.col("member")) & ~found).select(
        "query_id", "Assessment_url", "slug", "name", "recall", "n_hits", "n_relevant")


def missed_totals(ranked: DataFrame, judgments: DataFrame | Relevance, catalog: DataFrame, k: int = 10,
                  rank: str = "rank") -> DataFrame:
    """(slug, name, n_missed) of every judged URL that some query misses: H6 counted, without its rows."""
    missed = missed_by(as_relevance(judgments), ranked_slugs(ranked, k, rank)).withColumn("_u", py_strip(F.col("url")))
    named = missed.join(item_names(catalog), "_u", "left")
    return named.select("slug", F.coalesce(F.col("name"), F.lit("Unknown")).alias("name"), "n_missed")


def extreme_queries(per_query: DataFrame, n: int = 5, worst: bool = True) -> DataFrame:
    """H6 report: the n lowest (or highest) recall queries (a top-k report)."""
    order = [F.col("recall").asc() if worst else F.col("recall").desc(), F.col("query_id").asc()]
    return per_query.orderBy(*order).limit(n)


def top_missed(missed: DataFrame, n: int = 10) -> DataFrame:
    """H7: the most frequently missed item names (a top-n report) of ``missed_totals``."""
    return (missed.groupBy("name").agg(F.sum("n_missed").alias("n_missed"))
            .orderBy(F.col("n_missed").desc(), F.col("name").asc()).limit(n))


def low_recall_patterns(per_query: DataFrame, queries: DataFrame, patterns, threshold: float = 0.5,
                        text: str = "query") -> DataFrame:
    """H8: among queries with recall below ``threshold``, how many contain each pattern."""
    low = per_query.where(F.col("recall") < threshold).join(queries.select("query_id", text), "query_id")
    q_l = F.lower(F.col(text))
    counts = low.agg(F.count(F.lit(1)).alias("n_low"),
                     *[F.count_if(contains_any(q_l, terms)).alias(f"p{i}")
                       for i, (_, terms) in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(label).alias("pattern"), F.col(f"p{i}").alias("n_queries"))
                     for i, (label, _) in enumerate(patterns)])
    return counts.select("n_low", F.inline(rows))


# The suggestion texts attached to each finding.
SUGGESTION_LOW = "Widen the query vocabulary or use an embedder fitted to the domain"
SUGGESTION_MISSED = "Retrieve deeper, or find candidates that share meaning rather than words"
SUGGESTION_FREQUENT = "Check the names and descriptions of these items"


def suggestions(per_query: DataFrame, missed: DataFrame, low: float = 0.3, many: int = 5) -> DataFrame:
    """H9: threshold rules over per-query recall and ``missed_totals`` -> (ord, issue, suggestion) rows."""
    n_low = per_query.agg(F.count_if(F.col("recall") < low).alias("n")).select(
        F.lit(1).alias("ord"),
        F.concat(F.col("n").cast("string"), F.lit(f" queries have recall < {int(low * 100)}%")).alias("issue"),
        F.lit(SUGGESTION_LOW).alias("suggestion"), F.col("n"))
    n_many = per_query.agg(F.count_if((F.col("n_relevant") - F.col("n_hits")) > many).alias("n")).select(
        F.lit(2).alias("ord"),
        F.concat(F.col("n").cast("string"), F.lit(f" queries missing >{many} relevant assessments")).alias("issue"),
        F.lit(SUGGESTION_MISSED).alias("suggestion"), F.col("n"))
    top3 = (missed.groupBy("slug").agg(F.sum("n_missed").alias("c"))
            .orderBy(F.col("c").desc(), F.col("slug")).limit(3))
    freq = top3.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("c")).alias("nc"), F.col("slug").alias("s")))), lambda x: x["s"]), ", ").alias("names"),
        F.count(F.lit(1)).alias("n")).select(
        F.lit(3).alias("ord"),
        F.concat(F.lit("Most frequently missed assessments: "), F.col("names")).alias("issue"),
        F.lit(SUGGESTION_FREQUENT).alias("suggestion"), F.col("n"))
    return n_low.unionByName(n_many).unionByName(freq).where(F.col("n") > 0).drop("n")


def before_after(ranked_before: DataFrame, ranked_after: DataFrame, judgments: DataFrame | Relevance,
                 k: int = 10) -> DataFrame:
    """Per-query recall of two rankings side by side, with the change."""
    cols = ["query_id", "url", "alternate_urls", "rank"]
    both = ranked_before.select(*cols).withColumn("side", F.lit("before")).unionByName(
        ranked_after.select(*cols).withColumn("side", F.lit("after")))
    per = recall_at_k(both, judgments, k, by={"side": ["before", "after"]})
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("recall"))).alias(f"recall_{side}")
    return per.groupBy("query_id").agg(of("before"), of("after")).withColumn(
        "delta", F.col("recall_after") - F.col("recall_before"))
