"""Registered jobs: one callable (spark, sf_dir) -> DataFrame per operator.

Each job reads the input tables (through the adaptor views), runs the
operator over the whole table, and projects the columns the correctness
oracle compares. Ranks are exposed as bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query_text as qt
from ..functions.lexicon import derive_lexicon
from ..operators import retrieve as R
from ..functions.urls import alternate_url, url_to_slug
from ..operators import evaluate as H
from ..operators import output as O
from ..operators.fusion import ensemble
from ..operators.knn import knn_topk, pruning_report
from ..operators.rerank import apply_external_ranking, by_final_score, parse_ranking_response, rerank_prompt, rule_scores
from ..operators.lexicon_table import derive_rules, rules_of, understand_by_rules
from ..operators.relevance import Relevance, judged_urls
from ..operators.understand import understand_queries
from ..sources import adaptors
from ..session import cut_lineage, written
from ..sources.tables import table
from .recommend import candidate_scores, recommend


class Ctx:
    """Lazily built views shared by the jobs of one call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cat = self._qry = self._lex = self._uq = self._pool = self._scored = None

    @property
    def cat(self) -> DataFrame:
        if self._cat is None:
            self._cat = adaptors.catalog(self.spark, self.sf_dir)
        return self._cat

    @property
    def qry(self) -> DataFrame:
        if self._qry is None:
            self._qry = adaptors.queries(self.spark, self.sf_dir, self.cat)
        return self._qry

    @property
    def lex(self):
        if self._lex is None:
            self._lex = derive_lexicon(table(self.spark, self.sf_dir, "part"))
        return self._lex

    @property
    def understood(self) -> DataFrame:
        """Understood queries as a plan: a job that reads a few columns computes only these."""
        return understand_queries(self.qry, self.lex)

    @property
    def uq(self) -> DataFrame:
        """Understood queries; one row per query, read by both the k-NN collect and the
        candidate join, so it is written once to the shared checkpoint folder (a lineage
        cut that survives executor loss) instead of being recomputed."""
        if self._uq is None:
            self._uq = cut_lineage(self.understood)
        return self._uq

    @property
    def pool(self) -> DataFrame:
        """One exact k-NN pool shared by every strategy of a multi-strategy job (F9 asks deepest, 20 of each)."""
        if self._pool is None:
            self._pool = R.candidate_pool(self.uq, self.cat, R.pool_depth(20))
        return self._pool

    @property
    def scored(self) -> DataFrame:
        """Ids, ranks and scores of every query's hybrid candidates, those of the rules too: written once for jobs that rank them several times."""
        if self._scored is None:
            self._scored = written(candidate_scores(self.uq, self.cat, self.lex, also=rule_scores(self.lex, F.col("_name"))), "candidate-scores")
        return self._scored

    def relevance(self) -> Relevance:
        return adaptors.relevance(self.spark, self.sf_dir, self.cat, self.qry)

    def judged_urls(self) -> DataFrame:
        """Distinct judged URLs, as ``url``."""
        return judged_urls(self.relevance()).select(F.col("Assessment_url").alias("url"))

    def ranked(self, reranker: str = "rules", k: int = 10, shared: bool = False, query_columns: bool = False) -> DataFrame:
        return recommend(self.uq, self.cat, self.lex, k=k, reranker=reranker, understood=True,
                         shared=self.pool if shared else None, query_columns=query_columns)

    def external_ranking(self) -> DataFrame:
        """Stand-in external ranking: the boosted strategy's top 10 per query, written
        as a mirror URL (pos % 3 = 0), the alternate URL (pos % 3 = 1) or the URL. Then the first word
        of each slug, which several candidates contain, and each item once more under its other URL."""
        b = R.retrieve_boosted(self.uq, self.cat, k=10, pool=self.pool)
        mirror = F.concat(F.lit("https://mirror.example.org/catalog/view/"), url_to_slug(F.col("url")),
                          F.lit("/"))
        u = (F.when(F.col("rank") % 3 == 0, mirror).when(F.col("rank") % 3 == 1, alternate_url(F.col("url")))
             .otherwise(F.col("url")))
        word = F.concat(F.lit("https://mirror.example.org/catalog/view/"),
                        F.regexp_extract(url_to_slug(F.col("url")), "^[^-]+", 0))
        again = F.when(F.col("rank") % 2 == 0, alternate_url(F.col("url"))).otherwise(F.col("url"))
        listed = F.array(F.struct(F.col("rank").alias("pos"), u.alias("url")),
                         F.struct((F.col("rank") + 10).alias("pos"), word.alias("url")),
                         F.struct((F.col("rank") + 20).alias("pos"), again.alias("url")))
        return b.select("query_id", F.inline(listed))

    def replies(self) -> DataFrame:
        """Stand-in reply texts carrying the boosted top 10 URLs: fenced JSON, bare JSON or prose."""
        b = R.retrieve_boosted(self.uq, self.cat, k=10)
        g = b.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("_l"))
        urls = F.transform("_l", lambda x: x["url"])
        arr = F.concat(F.lit('["'), F.array_join(urls, '", "'), F.lit('"]'))
        text = (F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
                .when(F.col("query_id") % 3 == 1, arr)
                .otherwise(F.concat(F.lit("Ranking: "), F.array_join(urls, ", then "), F.lit(" end"))))
        return g.select("query_id", text.alias("reply"))

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


# ---------------------------------------------------------------- D: query understanding

def d1_clean_query(spark, sf):
    c = Ctx(spark, sf)
    return c.understood.select("query_id", "q_clean", "q_lower")


def d2_query_duration(spark, sf):
    c = Ctx(spark, sf)
    return c.understood.select("query_id", "q_duration",
                       qt.query_duration(F.col("q_lower"), "match").alias("q_duration_match"))


def d3_query_skills(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "skills")


def d4_query_roles(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "roles")


def d5_tag_prefs(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "tag_prefs")


def d6_expand_query(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "job_terms", "expanded")


def d7_boost_keywords(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "boost_terms")


def d8_boost_tokens(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "q_words", "boost_tokens")


def d9_fallback_terms(spark, sf):
    return Ctx(spark, sf).understood.select("query_id", "fb_skills", "fb_roles")


def d_reference_lexicon(spark, sf):
    """D1-D9 with the original's fixed lexicon over every user turn of the conversations."""
    from ..functions.lexicon import reference_lexicon
    turns = Ctx(spark, sf).t("conversations").where(F.col("role") == "user") \
        .select((F.concat_ws(":", "conv_id", "turn")).alias("query_id"), F.col("text").alias("query"))
    u = understand_queries(turns, reference_lexicon())
    return u.select("query_id", "q_duration", "skills", "roles", "tag_prefs", "expanded", "boost_terms",
                    "boost_tokens", "fb_skills", "fb_roles")


def d_reference_lexicon_documents(spark, sf):
    """D1-D9 with the original's fixed lexicon over every document (whole texts)."""
    from ..functions.lexicon import reference_lexicon
    docs = Ctx(spark, sf).t("documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    u = understand_queries(docs, reference_lexicon())
    return u.select("query_id", "q_duration", "skills", "roles", "tag_prefs", "expanded", "boost_terms",
                    "boost_tokens", "fb_skills", "fb_roles")


_TABLE_COLS = ("query_id", "q_duration", "skills", "roles", "tag_prefs", "expanded", "boost_terms", "boost_tokens", "fb_skills", "fb_roles")


def d_lexicon_table(spark, sf):
    """D1-D9 with the catalogue's vocabulary as a table of rules that never leaves Spark."""
    c = Ctx(spark, sf)
    return understand_by_rules(c.qry, derive_rules(c.t("part"))).select(*_TABLE_COLS)


def d_lexicon_table_documents(spark, sf):
    """D1-D9 with the original's fixed lexicon as a table of rules, over every document (whole texts)."""
    from ..functions.lexicon import reference_lexicon
    docs = Ctx(spark, sf).t("documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return understand_by_rules(docs, rules_of(spark, reference_lexicon())).select(*_TABLE_COLS)


# ---------------------------------------------------------------- E: vectors

def e6_knn_top10(spark, sf):
    c = Ctx(spark, sf)
    return knn_topk(c.qry, c.cat, 10).select("query_id", "item_id", "sim", big("sem_rank"))


def e6_knn_pruning(spark, sf):
    """How many (query, item) pairs the bounds of E6 leave out."""
    c = Ctx(spark, sf)
    return pruning_report(c.qry, c.cat, 10)


# ---------------------------------------------------------------- F: retrieval and re-ranking

def f1_retrieve_basic(spark, sf):
    c = Ctx(spark, sf)
    return R.retrieve_basic(c.uq, c.cat, k=20).select("query_id", "item_id", "score", big("rank"))


def f1_max_duration(spark, sf):
    """The duration filter comes after the vector top-k, so a query may get fewer than k items."""
    c = Ctx(spark, sf)
    return R.retrieve_basic(c.uq, c.cat, k=20, max_duration=25).select("query_id", "item_id", "score", big("rank"))


def f2_retrieve_semantic(spark, sf):
    c = Ctx(spark, sf)
    return R.retrieve_semantic(c.uq, c.cat, k=10).select("query_id", "item_id", "score", big("rank"))


def f3_retrieve_boosted(spark, sf):
    c = Ctx(spark, sf)
    return R.retrieve_boosted(c.uq, c.cat, k=10).select("query_id", "item_id", "boost", "score",
                                                        big("rank"))


def f4_hybrid_retrieve(spark, sf):
    c = Ctx(spark, sf)
    return R.hybrid_scores(c.uq, c.cat, c.lex.stopwords, k=100, depth=150).select(
        "query_id", "item_id", "sim", "keyword_score", "hybrid_score", big("hybrid_rank"))


def f5_keyword_retrieve(spark, sf):
    c = Ctx(spark, sf)
    return R.keyword_retrieve(c.uq, c.cat, k=20).select("query_id", "item_id", "score", big("rank"))


def f6_soft_penalties(spark, sf):
    c = Ctx(spark, sf)
    return candidate_scores(c.uq, c.cat, c.lex).select("query_id", "item_id", big("hybrid_rank"), "combined_score")


def f7_rerank_rules(spark, sf):
    c = Ctx(spark, sf)
    scored = candidate_scores(c.uq, c.cat, c.lex, also=rule_scores(c.lex, F.col("_name")))
    return by_final_score(scored).select("query_id", "item_id", "rerank_score", "final_score",
                                         big("rank"))


def f8_recommend_rules(spark, sf):
    c = Ctx(spark, sf)
    r = recommend(c.uq, c.cat, c.lex, k=10, reranker="rules", understood=True, query_columns=False)
    return r.select("query_id", big("rank"), "item_id", "url", "final_score")


def f8_recommend_none(spark, sf):
    c = Ctx(spark, sf)
    r = recommend(c.uq, c.cat, c.lex, k=10, reranker="none", understood=True, query_columns=False)
    return r.select("query_id", big("rank"), "item_id", "url", "final_score")


def f8_recommend_external(spark, sf):
    c = Ctx(spark, sf)
    r = recommend(c.uq, c.cat, c.lex, k=10, reranker="external", ranking=c.external_ranking(), understood=True,
                  shared=c.pool, query_columns=False)
    return r.select("query_id", big("rank"), "item_id", "url", "final_score")


def f11_rerank_fallback(spark, sf):
    c = Ctx(spark, sf)
    r = recommend(c.uq, c.cat, c.lex, k=10, reranker="fallback", understood=True, query_columns=False)
    return r.select("query_id", big("rank"), "item_id", "final_score")


def f9_ensemble(spark, sf):
    c = Ctx(spark, sf)
    return ensemble(c.uq, c.cat, c.lex, k=10, pool=c.pool).select(
        "query_id", "item_id", "ensemble_score", "rrf_score", "final_score", big("n_lists"), big("rank"))


def f10_external_ranking(spark, sf):
    c = Ctx(spark, sf)
    first = cut_lineage(candidate_scores(c.uq, c.cat, c.lex, shared=c.pool).where(F.col("hybrid_rank") <= 20))  # read twice
    cands = R.with_items(first, c.cat)
    return apply_external_ranking(cands, c.external_ranking(), 10).select(
        "query_id", "item_id", big("rank"), "from_external")


def f12_rerank_prompt(spark, sf):
    c = Ctx(spark, sf)
    first = candidate_scores(c.uq, c.cat, c.lex).where(F.col("hybrid_rank") <= 20)
    return rerank_prompt(R.with_items(first, c.cat), n=20).select(
        "query_id", "prompt", big("n_candidates"))


def f13_parse_ranking_response(spark, sf):
    c = Ctx(spark, sf)
    return c.replies().select("query_id", parse_ranking_response(F.col("reply")).alias("urls"))


def f14_format_response(spark, sf):
    c = Ctx(spark, sf)
    r = O.format_response(c.ranked(), c.qry)
    return r.select("query_id", "status", "n_results",
                    F.transform("recommended_assessments", lambda x: x["url"]).alias("urls"))


def f14_response_items(spark, sf):
    """The whole items of every response, in their order."""
    c = Ctx(spark, sf)
    r = O.format_response(c.ranked(), c.qry)
    rows = r.select("query_id", F.posexplode("recommended_assessments").alias("pos", "item"))
    return rows.select("query_id", big("pos"), "item.url", "item.name", "item.adaptive_support", "item.description", "item.duration",
                       "item.remote_support", "item.test_type")


# ---------------------------------------------------------------- H: evaluation

def _per_query(c: Ctx) -> DataFrame:
    return H.recall_at_k(c.ranked(), c.relevance(), 10)


def h1_recall_at_k(spark, sf):
    return _per_query(Ctx(spark, sf)).select("query_id", "n_relevant", "n_hits", "recall", "has_results")


def h2_mean_recall(spark, sf):
    m = H.mean_recall(_per_query(Ctx(spark, sf)), "zero")
    return m.select("n_queries", F.round("mean_recall", 6).alias("mean_recall"))


def h2_mean_recall_skip(spark, sf):
    m = H.mean_recall(_per_query(Ctx(spark, sf)), "skip")
    return m.select("n_queries", F.round("mean_recall", 6).alias("mean_recall"))


def h3_recall_stats(spark, sf):
    s = H.recall_stats(_per_query(Ctx(spark, sf)))
    return s.withColumn("mean_recall", F.round("mean_recall", 6))


def _strategies(c: Ctx) -> dict:
    p = c.pool
    return {"rules": c.ranked("rules", shared=True), "none": c.ranked("none", shared=True),
            "boosted": R.retrieve_boosted(c.uq, c.cat, k=10, pool=p),
            "basic": R.retrieve_basic(c.uq, c.cat, k=10, pool=p),
            "semantic": R.retrieve_semantic(c.uq, c.cat, k=10, pool=p),
            "keyword": R.keyword_retrieve(c.uq, c.cat, k=10, pool=p)}


def h4_compare_strategies(spark, sf):
    c = Ctx(spark, sf)
    out = H.compare_strategies(_strategies(c), c.relevance(), 10, baseline="semantic")
    return out.select("strategy", "n_queries", F.round("mean_recall", 6).alias("mean_recall"), "position",
                      "is_best", F.round("gain_over_baseline", 6).alias("gain_over_baseline"))


DEPTHS = (10, 15, 20, 30, 50)


def h5_sweep_depth(spark, sf):
    c = Ctx(spark, sf)
    out = H.sweep_depth(c.uq, c.cat, c.relevance(), DEPTHS, eval_k=10)
    return out.select(big("depth"), "n_queries", F.round("mean_recall", 6).alias("mean_recall"))


def _missed(c: Ctx) -> DataFrame:
    ranked = cut_lineage(c.ranked().select("query_id", "url", "alternate_urls", "rank"))  # read twice
    return H.miss_analysis(ranked, c.relevance(), c.cat, 10)


def h6_miss_analysis(spark, sf):
    return _missed(Ctx(spark, sf)).select("query_id", "Assessment_url", "slug", "name", "recall",
                                          "n_hits", "n_relevant")


def h6_worst_queries(spark, sf):
    return H.extreme_queries(_per_query(Ctx(spark, sf)), 5, worst=True).select("query_id", "recall")


def h7_top_missed(spark, sf):
    c = Ctx(spark, sf)
    return H.top_missed(H.missed_totals(c.ranked(), c.relevance(), c.cat, 10), 10)


def h8_low_recall_patterns(spark, sf):
    c = Ctx(spark, sf)
    return H.low_recall_patterns(_per_query(c), c.qry, c.lex.miss_patterns, 0.5)


def h9_suggestions(spark, sf):
    c = Ctx(spark, sf)
    ranked = cut_lineage(c.ranked().select("query_id", "url", "alternate_urls", "rank"))
    per_query = H.recall_at_k(ranked, c.relevance(), 10)
    missed = H.missed_totals(ranked, c.relevance(), c.cat, 10)
    return H.suggestions(per_query, missed).select(big("ord"), "issue", "suggestion")


def h10_before_after(spark, sf):
    c = Ctx(spark, sf)
    return H.before_after(c.ranked("none", shared=True), c.ranked("rules", shared=True), c.relevance(), 10)


def h10_external(spark, sf):
    c = Ctx(spark, sf)
    after = recommend(c.uq, c.cat, c.lex, k=10, reranker="external", ranking=c.external_ranking(), understood=True,
                      shared=c.pool, query_columns=False)
    return H.before_after(c.ranked("none", shared=True), after, c.relevance(), 10)


def h10_ensemble(spark, sf):
    c = Ctx(spark, sf)
    return H.before_after(c.ranked("rules", shared=True), ensemble(c.uq, c.cat, c.lex, k=10, pool=c.pool), c.relevance(), 10)


# ---------------------------------------------------------------- I: output

def i1_batch_predict(spark, sf):
    c = Ctx(spark, sf)
    return O.batch_predictions(c.ranked(), c.qry)


def i2_prediction_stats(spark, sf):
    c = Ctx(spark, sf)
    return O.prediction_stats(O.batch_predictions(c.ranked(), c.qry))


def i3_validate_predictions(spark, sf):
    c = Ctx(spark, sf)
    pred = O.batch_predictions(c.ranked(), c.qry).select("Query", "Assessment_url", "query_id", "rank")
    return O.validate_predictions(pred, c.qry)


def i4_result_summary(spark, sf):
    return O.result_summary(Ctx(spark, sf).ranked())


def i5_result_table(spark, sf):
    return O.result_table(Ctx(spark, sf).ranked())


JOBS = {
    "D1_clean_query": d1_clean_query,
    "D2_query_duration": d2_query_duration,
    "D3_query_skills": d3_query_skills,
    "D4_query_roles": d4_query_roles,
    "D5_tag_prefs": d5_tag_prefs,
    "D6_expand_query": d6_expand_query,
    "D7_boost_keywords": d7_boost_keywords,
    "D8_boost_tokens": d8_boost_tokens,
    "D9_fallback_terms": d9_fallback_terms,
    "D3_reference_lexicon": d_reference_lexicon,
    "D3_reference_lexicon_documents": d_reference_lexicon_documents,
    "D3_lexicon_table": d_lexicon_table,
    "D3_lexicon_table_documents": d_lexicon_table_documents,
    "E6_knn_top10": e6_knn_top10,
    "E6_knn_pruning": e6_knn_pruning,
    "F1_retrieve_basic": f1_retrieve_basic,
    "F1_max_duration": f1_max_duration,
    "F2_retrieve_semantic": f2_retrieve_semantic,
    "F3_retrieve_boosted": f3_retrieve_boosted,
    "F4_hybrid_retrieve": f4_hybrid_retrieve,
    "F5_keyword_retrieve": f5_keyword_retrieve,
    "F6_soft_penalties": f6_soft_penalties,
    "F7_rerank_rules": f7_rerank_rules,
    "F8_recommend_rules": f8_recommend_rules,
    "F8_recommend_none": f8_recommend_none,
    "F8_recommend_external": f8_recommend_external,
    "F9_ensemble": f9_ensemble,
    "F10_external_ranking": f10_external_ranking,
    "F11_rerank_fallback": f11_rerank_fallback,
    "F12_rerank_prompt": f12_rerank_prompt,
    "F13_parse_ranking_response": f13_parse_ranking_response,
    "F14_format_response": f14_format_response,
    "F14_response_items": f14_response_items,
    "H1_recall_at_k": h1_recall_at_k,
    "H2_mean_recall": h2_mean_recall,
    "H2_mean_recall_skip": h2_mean_recall_skip,
    "H3_recall_stats": h3_recall_stats,
    "H4_compare_strategies": h4_compare_strategies,
    "H5_sweep_depth": h5_sweep_depth,
    "H6_miss_analysis": h6_miss_analysis,
    "H6_worst_queries": h6_worst_queries,
    "H7_top_missed": h7_top_missed,
    "H8_low_recall_patterns": h8_low_recall_patterns,
    "H9_suggestions": h9_suggestions,
    "H10_before_after": h10_before_after,
    "H10_external": h10_external,
    "H10_ensemble": h10_ensemble,
    "I1_batch_predict": i1_batch_predict,
    "I2_prediction_stats": i2_prediction_stats,
    "I3_validate_predictions": i3_validate_predictions,
    "I4_result_summary": i4_result_summary,
    "I5_result_table": i5_result_table,
}
