"""Re-ranking operators (F6, F7, F10-F13) on per-query candidate rows.

Candidates arrive already partitioned by ``query_id`` (from the top-k
window), so the expressions are narrow and the final top-k reuses that
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonval import json_is_valid
from ..functions.lexicon import Lexicon
from ..functions.query_text import contains_any
from ..functions.urls import VIEW_MARKER, after_last, py_strip, rstrip_slashes
from .retrieve import _has, name_l, sum_over
from .topk import topk_per_group


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def soft_penalties(cands: DataFrame) -> DataFrame:
    """x0.9 when longer than 1.3x the asked duration; x0.95 when no preferred
    category matches. Nothing is dropped; ``combined_score`` is the result."""
    return cands.withColumn("combined_score", combined_score())


def combined_score() -> Column:
    """F6 of a candidate row."""
    qd = F.col("q_duration")
    dur = F.coalesce(F.col("duration"), F.lit(0))
    too_long = _truthy(qd) & (dur > 0) & (dur > qd * 1.3)
    no_tag = (F.size("tag_prefs") > 0) & ~F.exists(
        F.col("tag_prefs"), lambda t: F.array_contains(F.col("test_type"), t))
    score = F.col("hybrid_score") * F.when(too_long, 0.9).otherwise(1.0)
    score = score * F.when(no_tag, 0.95).otherwise(1.0)
    return score


def rule_score(lex: Lexicon, name: Column | None = None) -> Column:
    """F7 additive rule score of a candidate row; ``name`` is its name in lower case, if it is there already."""
    name = name_l() if name is None else name
    q_l = F.col("q_lower")
    qd = F.col("q_duration")
    dur = F.col("duration")
    return (sum_over(F.col("skills"), lambda s: F.when(_has(name, s), 0.30).otherwise(0.0))
            + sum_over(F.col("roles"), lambda r: F.when(_has(name, r), 0.25).otherwise(0.0))
            + F.when(_truthy(qd) & _truthy(dur) & (dur <= qd * 1.2), 0.15).otherwise(0.0)
            + sum_over(F.col("tag_prefs"),
                       lambda t: F.when(F.array_contains(F.col("test_type"), t), 0.10).otherwise(0.0))
            + F.when(contains_any(q_l, lex.entry_query) & contains_any(name, lex.entry_name),
                     0.10).otherwise(0.0)
            + F.when(contains_any(q_l, lex.senior_query) & contains_any(name, lex.senior_name),
                     0.10).otherwise(0.0)
            + F.when((F.instr(q_l, "remote") > 0) & (F.col("remote_support") == "Yes"),
                     0.05).otherwise(0.0))


def rule_scores(lex: Lexicon, name: Column | None = None) -> dict[str, Column]:
    """F7 as scores of pair rows that have ``combined_score``; the rule score is made once."""
    return {"_rule": rule_score(lex, name), "rerank_score": F.round("_rule", 6), "final_score": F.col("combined_score") + F.col("_rule")}


def rerank_rules(cands: DataFrame, lex: Lexicon, k: int | None = None,
                 prior: str = "hybrid_rank") -> DataFrame:
    """combined_score += rule score; stable re-sort (ties keep the prior order)."""
    out = cands
    for name, score in rule_scores(lex).items():
        out = out.withColumn(name, score)
    return by_final_score(out.drop("_rule"), k, prior)


def by_final_score(out: DataFrame, k: int | None = None, prior: str = "hybrid_rank") -> DataFrame:
    """Rows in order of ``final_score`` (ties keep the prior order), all or the first k."""
    order = [F.col("final_score").desc(), F.col(prior).asc(), F.col("item_id").asc()]
    if k is None:
        return out.withColumn("rank", F.row_number().over(
            Window.partitionBy("query_id").orderBy(*order)))
    return topk_per_group(out, ["query_id"], order, k)


def fallback_score(name: Column | None = None) -> Column:
    """F11 of a candidate row."""
    name = name_l() if name is None else name
    return (F.col("combined_score")
            + sum_over(F.col("fb_skills"), lambda t: F.when(_has(name, t), 0.20).otherwise(0.0))
            + sum_over(F.col("fb_roles"), lambda t: F.when(_has(name, t), 0.15).otherwise(0.0)))


def rerank_fallback(cands: DataFrame, k: int, prior: str = "hybrid_rank") -> DataFrame:
    """combined + 0.20 per D9 skill in the name + 0.15 per D9 role in the name; top k."""
    out = cands.withColumn("final_score", fallback_score())
    return topk_per_group(out, ["query_id"],
                          [F.col("final_score").desc(), F.col(prior).asc(), F.col("item_id").asc()], k)


def slug_of_external(url: Column, marker: str = VIEW_MARKER) -> Column:
    """Slug used for partial matching of an external URL (text after the last marker)."""
    return F.when(F.instr(url, marker) > 0, rstrip_slashes(after_last(url, marker))).otherwise(url)


def _walk_listed(entries: Column, listed: Column) -> Column:
    """Item ids that the listed URLs pick, in order; an item may come up twice.

    ``entries`` are the (u, item_id) pairs of a query's candidates, primary URLs first. A URL picks
    the entry that equals it, unless that URL was used; then (and if none equals it) the first entry
    whose unused URL contains its slug.
    """
    state = "struct<seen:array<string>,picks:array<bigint>>"
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("picks"))

    def step(s: Column, ext: Column) -> Column:
        unused = lambda u: ~F.array_contains(s["seen"], u)
        exact = F.filter(entries, lambda e: (e["u"] == ext) & unused(ext))
        partial = F.filter(entries, lambda e: (F.instr(e["u"], slug_of_external(ext)) > 0) & unused(e["u"]))
        hit = F.try_element_at(F.concat(F.slice(exact, 1, 1), F.slice(partial, 1, 1)), F.lit(1))
        taken = F.struct(F.concat(s["seen"], F.array(hit["u"])).alias("seen"),
                         F.concat(s["picks"], F.array(hit["item_id"])).alias("picks"))
        return F.when(hit.isNull(), s).otherwise(taken).cast(state)

    return F.aggregate(listed, start.cast(state), step, lambda s: s["picks"])


def apply_external_ranking(cands: DataFrame, ranking: DataFrame, k: int,
                           prior: str = "hybrid_rank") -> DataFrame:
    """merge an externally supplied ordered URL list into the candidates.

    ``ranking`` has (query_id, pos, url). The listed URLs are walked in order; each picks the
    candidate whose URL or alternate equals it, otherwise the first candidate (prior order, primary
    URLs before alternates) with an unused URL that contains its slug. An item is used once (its
    first position). Unlisted candidates fill the remaining slots in prior order.

    Both arrays are bounded per query: the candidates by the caller's depth, the list by what
    was supplied for it.
    """
    alternates = F.coalesce(F.col("alternate_urls"), F.array().cast("array<string>"))
    c = cands.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col(prior).alias("p"), F.col("item_id").cast("bigint").alias("item_id"), F.col("url"),
        alternates.alias("alts")))).alias("_c"))
    listed = ranking.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))),
                                                         lambda x: x["url"]).alias("_l"))
    pair = lambda u, i: F.struct(u.alias("u"), i.alias("item_id"))
    own = F.transform("_c", lambda x: pair(x["url"], x["item_id"]))
    other = F.flatten(F.transform("_c", lambda x: F.transform(x["alts"], lambda a: pair(a, x["item_id"]))))
    entries = F.filter(F.concat(own, other), lambda e: e["u"].isNotNull())
    met = c.join(listed, "query_id", "left").select(
        "query_id", F.transform("_c", lambda x: x["item_id"]).alias("_ids"), entries.alias("_e"),
        F.coalesce("_l", F.array().cast("array<string>")).alias("_l"))
    met = met.withColumn("_picks", F.array_distinct(_walk_listed(F.col("_e"), F.col("_l"))))
    order = F.slice(F.array_distinct(F.concat("_picks", "_ids")), 1, k)
    ranked = met.select("query_id", F.size("_picks").alias("_n"), F.posexplode(order).alias("_at", "_id"))
    ranked = ranked.select("query_id", F.col("_id").cast(cands.schema["item_id"].dataType).alias("item_id"),
                           (F.col("_at") + 1).alias("rank"), (F.col("_at") < F.col("_n")).alias("from_external"))
    return ranked.join(cands.drop("rank"), ["query_id", "item_id"], "inner")


def rerank_prompt(cands: DataFrame, n: int = 20, desc_chars: int = 150,
                  prior: str = "hybrid_rank") -> DataFrame:
    """numbered candidate block per query (first ``n`` candidates in prior order)."""
    top = cands.where(F.col(prior) <= n)
    tags = F.when(F.size(F.coalesce("test_type", F.array().cast("array<string>"))) > 0,
                  F.array_join("test_type", ", ")).otherwise(F.lit("Unknown"))
    dur = F.coalesce(F.col("duration"), F.lit(0))
    line = F.concat(
        F.col(prior).cast("string"), F.lit(". "), F.coalesce(F.col("name"), F.lit("Unknown")), F.lit("\n"),
        F.lit("   Description: "), F.substring(F.coalesce(F.col("description"), F.lit("")), 1, desc_chars),
        F.lit("...\n"), F.lit("   Test Types: "), tags, F.lit("\n"),
        F.when(dur != 0, F.concat(F.lit("   Duration: "), dur.cast("string"), F.lit(" minutes\n")))
         .otherwise(F.lit("")),
        F.lit("   URL: "), F.col("url"), F.lit("\n\n"))
    return (top.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(prior).alias("p"), line.alias("l"))))
                 .alias("_lines"))
            .select("query_id", F.array_join(F.transform("_lines", lambda x: x["l"]), "").alias("prompt"),
                    F.size("_lines").alias("n_candidates")))


def parse_ranking_response(text: Column) -> Column:
    """URL list from a reply.

    A ```json fence -> its content; otherwise, when fences occur, the first
    fence-separated part that starts with '[' or '{'. Valid JSON: its array
    (an empty array when it is not a non-empty array). Invalid JSON: every
    http(s) URL in the text.
    """
    t = py_strip(text)
    after_json = py_strip(F.regexp_extract(t, r"(?s)```json(.*?)(?:```|\z)", 1))
    bracketed = F.try_element_at(
        F.filter(F.split(t, "```"), lambda p: py_strip(p).startswith("[") | py_strip(p).startswith("{")),
        F.lit(1))
    body = (F.when(F.instr(t, "```json") > 0, after_json)
            .when(F.instr(t, "```") > 0, F.coalesce(py_strip(bracketed), t))
            .otherwise(t))
    parsed = F.from_json(body, "array<string>")
    valid = json_is_valid(body)
    return (F.when(valid & parsed.isNotNull() & (F.size(parsed) > 0), parsed)
            .when(valid, F.array().cast("array<string>"))
            .otherwise(F.regexp_extract_all(body, F.lit(r"https?://[^\s,\]]+"), 0)))
