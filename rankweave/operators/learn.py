"""Learned ranking.

Features are column expressions over candidate rows (no UDF); training pairs
are the rule pipeline's candidates labelled by a slug look-up in the
judgments; the model is boosted trees (``boosting``) whose sums come from Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query_text import WORD_RE
from ..functions.urls import url_variants
from .boosting import Booster, Params, train
from .relevance import Relevance, as_relevance, class_slugs, hits, judged_queries
from .topk import topk_per_group

# The 17 ranking features, in model order.
FEATURES = ("semantic_score", "combined_score", "name_keyword_matches", "name_keyword_ratio",
            "desc_keyword_matches", "desc_keyword_ratio", "exact_name_match", "duration_match",
            "duration_diff", "test_type_matches", "test_type_match_ratio", "skill_name_matches",
            "role_name_matches", "remote_support", "adaptive_support", "name_length", "desc_length")

FEATURE_COLS = tuple(f"f_{n}" for n in FEATURES)


STEPS = ("_name_l", "_desc_l", "_long_words", "_in_name", "_n_in_desc")


def _d(c: Column) -> Column:
    return c.cast("double")


def ranking_features(cands: DataFrame, semantic: str = "hybrid_score",
                     combined: str = "combined_score") -> DataFrame:
    """G1: the 17 features of each (query, candidate) row, as double columns ``f_<name>``.

    ``semantic`` is the candidate's pre-penalty hybrid score (what the
    original stores as its distance) and ``combined`` its current score.
    """
    # steps in columns of their own: what several columns read as an expression is computed for each of them
    found = F.col("q_words") if "q_words" in cands.columns else F.array_distinct(F.regexp_extract_all(F.col("q_raw_lower"), F.lit(WORD_RE), 0))
    name_l, desc_l, words, matched, dm = (F.col(c) for c in STEPS)
    steps = cands.withColumns(dict(zip(STEPS, (F.lower(F.coalesce(F.col("name"), F.lit(""))), F.lower(F.coalesce(F.col("description"), F.lit(""))),
                                               F.filter(found, lambda w: F.length(w) > 2)))))
    steps = steps.withColumn(STEPS[3], F.filter(words, lambda w: F.contains(name_l, w)))
    steps = steps.withColumn(STEPS[4], F.size(F.filter(words, lambda w: F.contains(desc_l, w))))
    n_words, nm = F.size(words), F.size(matched)
    qd = F.col("q_duration")
    cd = F.coalesce(F.col("duration"), F.lit(0))
    both_dur = qd.isNotNull() & (qd != 0) & (cd != 0)
    big_dur = F.greatest(cd.cast("double"), qd.cast("double"))
    prefs = F.coalesce(F.col("tag_prefs"), F.array().cast("array<string>"))
    tags = F.coalesce(F.col("test_type"), F.array().cast("array<string>"))
    both_tags = (F.size(prefs) > 0) & (F.size(tags) > 0)
    tmatch = F.size(F.array_intersect(prefs, tags))
    feats = {
        "semantic_score": _d(F.col(semantic)),
        "combined_score": _d(F.col(combined)),
        "name_keyword_matches": _d(nm),
        "name_keyword_ratio": F.when(n_words > 0, nm / n_words).otherwise(0.0),
        "desc_keyword_matches": _d(dm),
        "desc_keyword_ratio": F.when(n_words > 0, dm / n_words).otherwise(0.0),
        "exact_name_match": F.when(F.exists(matched, lambda w: F.length(w) > 4), 1.0).otherwise(0.0),
        "duration_match": F.when(both_dur, F.when(big_dur > 0, F.least(cd, qd) / big_dur).otherwise(0.0))
                           .otherwise(0.5),
        "duration_diff": F.when(both_dur, F.abs(qd - cd) / 60.0).otherwise(0.0),
        "test_type_matches": F.when(both_tags, _d(tmatch)).otherwise(0.0),
        "test_type_match_ratio": F.when(both_tags, tmatch / F.size(prefs)).otherwise(0.0),
        "skill_name_matches": _d(F.size(F.filter(F.col("skills"), lambda s: F.contains(name_l, F.lower(s))))),
        "role_name_matches": _d(F.size(F.filter(F.col("roles"), lambda s: F.contains(name_l, F.lower(s))))),
        "remote_support": F.when(F.col("remote_support") == "Yes", 1.0).otherwise(0.0),
        "adaptive_support": F.when(F.col("adaptive_support") == "Yes", 1.0).otherwise(0.0),
        "name_length": F.length(name_l) / 100.0,
        "desc_length": F.length(desc_l) / 500.0,
    }
    return steps.withColumns({f"f_{k}": v for k, v in feats.items()}).drop(*STEPS)


def label_candidates(cands: DataFrame, judgments: DataFrame | Relevance, items: DataFrame | None = None) -> DataFrame:
    """Candidates of judged queries with ``label`` = 1 when any variant slug is relevant.

    With the table of ``items`` that the candidates come from, variants are made once for each of its URLs.
    """
    rel = as_relevance(judgments)
    slugs = class_slugs(rel)
    c = cands.drop("label").join(judged_queries(rel, slugs).select("query_id"), "query_id", "left_semi")
    asked = c.select("query_id", "item_id", "url", "alternate_urls")
    variants = F.explode(url_variants(F.col("url"), F.col("alternate_urls"))).alias("slug")
    if items is None:
        asked = asked.select("query_id", "item_id", variants)
    else:
        of = items.select("url", "alternate_urls").distinct().select(F.struct("url", "alternate_urls").alias("_u"), variants)
        asked = asked.select("query_id", "item_id", F.struct("url", "alternate_urls").alias("_u")).join(of, "_u")
    found = hits(rel, asked, slugs).select("query_id", "item_id").distinct().withColumn("label", F.lit(1.0))
    return c.join(found, ["query_id", "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def training_pairs(ruled: DataFrame, judgments: DataFrame | Relevance, items: DataFrame | None = None) -> DataFrame:
    """Rule-pipeline candidates (rank <= depth) of judged queries with features and label.

    ``combined_score`` is the score after penalties and before rules, as it is when a fitted model
    scores candidates (G5).
    """
    return ranking_features(label_candidates(ruled, judgments, items))


def train_ranker(pairs: DataFrame, params: Params = Params(), **where) -> Booster:
    """Boosted trees on the 17 features, positives weighted by negatives/positives."""
    return train(pairs, list(FEATURE_COLS), "label", ("query_id", "item_id"), params, **where)


def save_ranker(spark, model: Booster, path: str) -> str:
    """Persist the model (to a fresh path)."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(path)
    return path


def load_ranker(spark, path: str) -> Booster | None:
    """Load a fitted model; None when nothing is stored at ``path``."""
    from ..sources.files import path_exists
    if not path_exists(spark, path):
        return None
    return Booster.from_json(spark.read.text(path).first()["value"])


def first_splits(model: Booster, nodes: int = 3) -> list[tuple]:
    """(node, feature, bin, gain, value) of the first tree's first nodes, those that aren't there left out."""
    t = model.trees[0]
    there = [i for i in range(min(nodes, len(t.feature))) if i == 0 or t.feature[(i - 1) // 2] >= 0]
    return [(i, model.features[t.feature[i]][2:] if t.feature[i] >= 0 else None, t.bin[i], t.gain[i], t.value[i]) for i in there]


def feature_importances(model: Booster) -> list[tuple[str, float]]:
    return [(f[2:], v) for f, v in model.importances()]


def rerank_learned(cands: DataFrame, model: Booster | None, k: int,
                   prior: str = "hybrid_rank") -> DataFrame:
    """Order candidates by P(relevant) from the model; without a model keep the first k."""
    if model is None:
        return topk_per_group(cands.withColumn("final_score", F.col("combined_score")), ["query_id"],
                              [F.col(prior).asc()], k)
    rows = ranking_features(cands)
    scored = rows.withColumn("final_score", model.probability(rows, list(FEATURE_COLS))).drop(*FEATURE_COLS)
    return topk_per_group(scored, ["query_id"], [F.col("final_score").desc(), F.col(prior).asc(),
                                                 F.col("item_id").asc()], k)
