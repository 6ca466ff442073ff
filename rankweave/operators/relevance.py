"""Judgments as classes of relevance.

Queries that judge the same items share a class, so a judgment table of queries x items never exists as rows:
there is a row for each query and a row for each item of a class. Judgments that come as (query, URL) pairs
are the case where every query has a class of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import VIEW_MARKER, py_strip, url_to_slug


CLASS_TASKS = 32      # tasks over which the queries of a class are dealt where all pairs are listed


class Relevance(NamedTuple):
    """``queries`` (query_id, class_id, own) and ``members`` (class_id, member, url).

    A query judges all members of its class except the one that it calls its ``own`` (null: none).
    """
    queries: DataFrame
    members: DataFrame

    def where(self, condition: Column) -> Relevance:
        """Only queries that meet a condition on ``query_id``."""
        return Relevance(self.queries.where(condition), self.members)

    def pairs(self) -> DataFrame:
        """(query_id, Assessment_url, slug): every judgment as a row, for reports that list them all."""
        met = each_with_each(self.queries, self.members).where(counts_for(F.col("member")))
        return met.select("query_id", F.col("url").alias("Assessment_url"), slug_of(F.col("url")).alias("slug"))


def each_with_each(queries: DataFrame, members: DataFrame, salts: int = CLASS_TASKS) -> DataFrame:
    """Rows of ``queries`` with the rows of ``members`` of their class.

    The queries of a class are dealt over ``salts`` tasks, each with all its members: there may be few classes.
    """
    dealt = queries.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    copies = members.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, ["class_id", "_salt"]).drop("_salt")


def slug_of(url: Column, marker: str = VIEW_MARKER) -> Column:
    return url_to_slug(py_strip(url), marker)


def counts_for(member: Column) -> Column:
    """Whether a member (null: no one's own) is judged by a query with ``own``."""
    return F.coalesce(member != F.col("own"), F.lit(True))


def from_pairs(judgments: DataFrame, url: str = "Assessment_url") -> Relevance:
    """Relevance of a (query_id, url) table: one class for each query."""
    none = F.lit(None).cast(judgments.schema["query_id"].dataType)
    queries = judgments.select("query_id").distinct().select("query_id", F.col("query_id").alias("class_id"), none.alias("own"))
    return Relevance(queries, judgments.select(F.col("query_id").alias("class_id"), none.alias("member"), F.col(url).alias("url")))


def as_relevance(judgments: DataFrame | Relevance) -> Relevance:
    return judgments if isinstance(judgments, Relevance) else from_pairs(judgments)


def class_slugs(rel: Relevance, marker: str = VIEW_MARKER) -> DataFrame:
    """Distinct (class_id, slug); ``only`` is the one member that has the slug, null if several have it."""
    m = rel.members.select("class_id", "member", slug_of(F.col("url"), marker).alias("slug"))
    alone = (F.min("member") == F.max("member")) & (F.count("member") == F.count(F.lit(1)))
    return m.groupBy("class_id", "slug").agg(F.when(alone, F.min("member")).alias("only"))


def judged_queries(rel: Relevance, slugs: DataFrame) -> DataFrame:
    """(query_id, class_id, own, n_relevant) of the queries that judge anything."""
    size = slugs.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"))
    own = slugs.where(F.col("only").isNotNull()).groupBy("class_id", F.col("only").alias("own")).agg(F.count(F.lit(1)).alias("_own"))
    met = rel.queries.join(size, "class_id").join(own, ["class_id", "own"], "left")
    return met.select("query_id", "class_id", "own", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("n_relevant")).where("n_relevant > 0")


def hits(rel: Relevance, found: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """The rows of ``found`` (query_id, slug, ...) whose slug is relevant to their query, with class_id and own."""
    slugs = class_slugs(rel) if slugs is None else slugs
    met = found.join(rel.queries, "query_id").join(slugs, ["class_id", "slug"])
    return met.where(counts_for(F.col("only"))).drop("only")


def judged_urls(rel: Relevance) -> DataFrame:
    """Distinct ``Assessment_url`` of the members that some query judges, with the number of queries ``n_queries``."""
    size = rel.queries.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"))
    own = rel.queries.where(F.col("own").isNotNull()).groupBy("class_id", F.col("own").alias("member")).agg(F.count(F.lit(1)).alias("_own"))
    met = rel.members.join(size, "class_id").join(own, ["class_id", "member"], "left")
    n = F.col("_n") - F.coalesce("_own", F.lit(0))
    return met.select(F.col("url").alias("Assessment_url"), n.alias("_q")).where("_q > 0").groupBy("Assessment_url").agg(
        F.sum("_q").alias("n_queries"))


def judged_items(rel: Relevance, items_of: DataFrame) -> DataFrame:
    """Distinct (query_id, Assessment_url, item_id) of every judgment whose URL stands in ``items_of`` (url, item_id).

    A class's distinct rows are made before they meet its queries, so the pairs themselves are only shuffled where
    a query has several classes.
    """
    alone = (F.min("member") == F.max("member")) & (F.count("member") == F.count(F.lit(1)))
    urls = rel.members.groupBy("class_id", "url").agg(F.when(alone, F.min("member")).alias("only"))
    members = urls.join(items_of.distinct(), "url").select("class_id", F.col("url").alias("Assessment_url"), "item_id", "only")
    queries = rel.queries.distinct()
    several = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    queries = queries.join(several, queries["query_id"].eqNullSafe(several["query_id"])).drop(several["query_id"])
    listed = lambda q: each_with_each(q, members).where(counts_for(F.col("only"))).select(
        "query_id", "Assessment_url", "item_id")
    return listed(queries.where("_n = 1")).unionByName(listed(queries.where("_n > 1")).distinct())


def missed_by(rel: Relevance, found: DataFrame) -> DataFrame:
    """(class_id, member, url, slug, n_missed): by how many of its queries each judged URL is missed.

    ``found`` has the (query_id, slug) rows that the queries did get. Rows are those of members and of hits.
    """
    size = rel.queries.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"))
    own = rel.queries.where(F.col("own").isNotNull()).groupBy("class_id", F.col("own").alias("member")).agg(F.count(F.lit(1)).alias("_own"))
    each = rel.members.groupBy("class_id", "member", "url").agg(F.count(F.lit(1)).alias("_times")).withColumn("slug", slug_of(F.col("url")))
    got = hits(rel, found.select("query_id", "slug").distinct()).select("class_id", "slug", "own", F.lit(1).alias("_hit"))
    held = each.join(got, ["class_id", "slug"], "left").groupBy("class_id", "member", "url", "slug", "_times").agg(
        F.count_if(F.col("_hit").isNotNull() & counts_for(F.col("member"))).alias("_got"))
    met = held.join(size, "class_id").join(own, ["class_id", "member"], "left")
    n = F.col("_times") * (F.col("_n") - F.coalesce("_own", F.lit(0)) - F.col("_got"))
    return met.select("class_id", "member", "url", "slug", n.alias("n_missed")).where("n_missed > 0")
