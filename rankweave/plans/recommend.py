"""F8 recommend: the flagship plan, for every query of a table in one job.

understand (D1-D6, narrow) -> hybrid retrieval (E6 top-150 + keyword score,
top 100) -> soft penalties (F6) -> re-ranker -> top k.

``reranker`` is explicit and there is no silent fallback:
  'none'     first k in hybrid order
  'rules'    F7 on all hybrid candidates
  'fallback' F11 on all hybrid candidates
  'external' F10 on the first 2k candidates, with a supplied ranking table
  'learned'  G5 on the first 3k candidates, with a fitted model
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..operators.rerank import apply_external_ranking, by_final_score, combined_score, fallback_score, rule_scores
from ..operators.retrieve import hybrid_scores, with_items, with_queries
from ..operators.understand import understand_queries
from ..session import cut_lineage


RULE_COLS = ("rerank_score", "final_score")


def candidate_scores(uq: DataFrame, items: DataFrame, lex: Lexicon, pool: int = 100, depth: int = 150, shared=None,
                     also: dict | None = None) -> DataFrame:
    """F4 + F6 as narrow rows, and the scores ``also`` of each; the pool every re-ranker starts from.
    ``shared`` is an optional precomputed k-NN pool at least ``depth`` deep."""
    scores = {"combined_score": combined_score(), **(also or {})}
    return hybrid_scores(uq, items, lex.stopwords, k=pool, depth=depth, pool=shared, also=scores)


def candidates_for_rerank(uq: DataFrame, items: DataFrame, lex: Lexicon, pool: int = 100,
                          depth: int = 150, shared=None, first: int | None = None, scored: DataFrame | None = None) -> DataFrame:
    """``candidate_scores`` (``scored``, if they are there) with the columns of items and queries, of all candidates or the ``first`` of each query."""
    cands = candidate_scores(uq, items, lex, pool, depth, shared) if scored is None else scored.drop(*RULE_COLS)
    if first is not None:
        cands = cands.where(F.col("hybrid_rank") <= first)
    return with_queries(with_items(cands, items), uq)


def recommend(queries: DataFrame, items: DataFrame, lex: Lexicon, k: int = 10,
              reranker: str = "rules", ranking: DataFrame | None = None, model=None,
              understood: bool = False, pool: int = 100, depth: int = 150, shared=None,
              embedder=None, query_columns: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """``embedder(df, text, out)`` makes the query vectors from the expanded queries (D6); without one,
    ``queries`` brings them as ``qvec``. The ranked rows have the columns of items, and with ``query_columns`` those of queries.
    ``scored`` are candidates of the same queries and items scored before, by ``candidate_scores`` with the rules' scores."""
    uq = queries if understood else understand_queries(queries, lex)
    if embedder is not None:
        uq = embedder(uq.drop("qvec"), "expanded", "qvec")
    name = F.col("_name")
    if scored is not None and reranker == "fallback":
        raise ValueError("scored candidates have no fallback score")

    def scores(also: dict | None = None) -> DataFrame:
        if scored is None:
            return candidate_scores(uq, items, lex, pool, depth, shared, also)
        return scored if also else scored.drop(*RULE_COLS)

    if reranker == "none":
        out = scores().where(F.col("hybrid_rank") <= k).withColumn("final_score", F.col("combined_score")) \
            .withColumn("rank", F.col("hybrid_rank"))
    elif reranker == "rules":
        out = by_final_score(scores(rule_scores(lex, name)), k)
    elif reranker == "fallback":
        out = by_final_score(scores({"final_score": fallback_score(name)}), k)
    elif reranker == "external":
        if ranking is None:
            raise ValueError("reranker='external' needs a ranking table")
        first = cut_lineage(scores().where(F.col("hybrid_rank") <= 2 * k))  # read twice
        out = apply_external_ranking(with_items(first, items), ranking, k).withColumn("final_score", F.col("combined_score"))
        return with_queries(out, uq) if query_columns else out.drop("_qrow")
    elif reranker == "learned":
        if model is None:
            raise ValueError("reranker='learned' needs a fitted model")
        from ..operators.learn import rerank_learned
        first = scores().where(F.col("hybrid_rank") <= 3 * k)
        return rerank_learned(with_queries(with_items(first, items), uq), model, k)
    else:
        raise ValueError(f"unknown reranker {reranker!r}")
    out = with_items(out, items)
    return with_queries(out, uq) if query_columns else out.drop("_qrow")
