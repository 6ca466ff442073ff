"""Query understanding over a whole table of queries.

One narrow projection: no shuffle, no join; lexicons are inlined literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query_text as qt
from ..functions.lexicon import Lexicon
from ..functions.urls import py_strip


def understand_queries(queries: DataFrame, lex: Lexicon, text: str = "query",
                       unit_scope: str = "query") -> DataFrame:
    """Adds the query-information columns used by retrieval and re-ranking.

    q_raw_lower  lower-case raw text (the basic/boosted/keyword retrievers use it)
    q_clean      D1 cleaned text;   q_lower  its lower-case copy
    q_duration   D2 minutes (null when absent)
    skills       D3, roles D4, tag_prefs D5 (bag), job_terms, expanded D6 (+ lower copy)
    boost_terms  D7, boost_tokens D8, fb_skills / fb_roles D9
    """
    lex.check_size()
    clean = qt.clean_query(F.col(text))
    return (queries
            .withColumn("q_raw_lower", F.lower(F.col(text)))
            .withColumn("q_clean", clean)
            .withColumn("q_lower", F.lower(F.col("q_clean")))
            .withColumn("q_duration", qt.query_duration(F.col("q_lower"), unit_scope))
            .withColumn("skills", qt.query_skills(F.col("q_lower"), lex))
            .withColumn("roles", qt.query_roles(F.col("q_lower"), lex))
            .withColumn("tag_prefs", qt.query_tag_prefs(F.col("q_lower"), lex))
            .withColumn("job_terms", qt.job_terms(F.col("q_lower"), lex))
            .withColumn("expanded", qt.expand_query(F.col("q_clean"), F.col("skills"),
                                                    F.col("roles"), F.col("job_terms")))
            .withColumn("expanded_lower", F.lower(F.col("expanded")))
            .withColumn("boost_terms", qt.boost_keywords(F.col("q_raw_lower"), lex))
            .withColumn("boost_tokens", qt.boost_tokens(F.col("q_raw_lower"), lex))
            .withColumn("q_words", qt.query_words(F.col("q_raw_lower")))
            .withColumn("fb_skills", qt.fallback_terms(F.col("q_raw_lower"), lex.fallback_skills))
            .withColumn("fb_roles", qt.fallback_terms(F.col("q_raw_lower"), lex.fallback_roles)))


def resolve_url_queries(queries: DataFrame, pages: DataFrame, text: str = "query",
                        boilerplate=(), page_order: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Queries that are URLs are replaced by the cleaned text of that page.

    Returns (resolved, rejects). The query is stripped first. Text queries pass on; empty ones, URLs
    without a page and pages without text go to ``rejects``. Of several pages with one URL the first
    (by ``page_order``) counts. Only URL queries are joined, and only pages that are asked for are
    cleaned.
    """
    from ..functions.text import html_to_text, strip_boilerplate
    q = queries.withColumn("_q", py_strip(F.col(text)))
    is_url = F.coalesce(F.col("_q").rlike(r"^https?://"), F.lit(False))
    empty = F.coalesce(F.col("_q"), F.lit("")) == ""
    plain = q.where(~is_url & ~empty).withColumn(text, F.col("_q")).drop("_q")
    asked = q.where(is_url)
    # an inner join: Spark pushes a semi join below a union of pages and then takes its parts for one partitioning
    first = (pages.join(asked.select(F.col("_q").alias("url")).distinct(), "url")
             .groupBy("url").agg(F.min_by("html", page_order).alias("html")))
    found = first.select(F.col("url").alias("_q"),
                         strip_boilerplate(html_to_text(F.col("html")), boilerplate).alias("_page_text"))
    met = asked.join(found, "_q", "left").withColumn("_ok", F.coalesce(F.col("_page_text"), F.lit("")) != "")
    resolved = met.where("_ok").withColumn(text, F.col("_page_text")).drop("_q", "_page_text", "_ok")
    rejects = met.where("NOT _ok").drop("_q", "_page_text", "_ok").unionByName(q.where(empty).drop("_q"))
    return plain.unionByName(resolved), rejects
