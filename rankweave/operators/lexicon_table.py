"""Query understanding (D3-D9) with the lexicon as a table of rules, of any size.

A rule row is (kind, ord, trigger, values): a query that contains the trigger gets the values, rules of a
kind in the order of ``ord``. Several triggers of one rule are several rows with one ord. Triggers are found by
an automaton (``terms``); everything after that is joins and aggregates over the matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query_text as qt
from ..functions.lexicon import DERIVED_MULTI_RULE, Lexicon, reference_lexicon
from .terms import match_terms

RULES = "kind string, ord long, trigger string, values array<string>"
# kind -> (column that understanding adds, text that its triggers are looked for in)
SUBSTRING_KINDS = {"skill": ("skills", "q_lower"), "role": ("roles", "q_lower"), "tag": ("tag_prefs", "q_lower"),
                   "job": ("job_terms", "q_lower"), "boost": ("boost_terms", "q_raw_lower"),
                   "fb_skill": ("fb_skills", "q_raw_lower"), "fb_role": ("fb_roles", "q_raw_lower")}
ONCE = ("skill", "role")     # kinds whose values count once; the others are bags


def rules_of(spark: SparkSession, lex: Lexicon) -> DataFrame:
    """The rules of an inline lexicon."""
    rows = [("skill", i, v, list(vs)) for i, (_, vs) in enumerate(lex.concepts) for v in vs]
    rows += [("role", i, v, [r]) for i, (r, vs) in enumerate(lex.roles) for v in vs]
    for kind, rules in (("tag", lex.tag_rules), ("job", lex.job_rules)):
        rows += [(kind, i, t, list(vs)) for i, (ts, vs) in enumerate(rules) for t in ts]
    for kind, terms in (("boost", lex.boost_terms), ("fb_skill", lex.fallback_skills), ("fb_role", lex.fallback_roles), ("token", lex.token_terms)):
        rows += [(kind, i, t, [t]) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, RULES)


def derive_rules(part: DataFrame) -> DataFrame:
    """The rules of ``derive_lexicon``, computed by Spark: no vocabulary goes to the driver.

    ``ord`` only has to keep the order of rules, so terms of one kind are numbered by their rank.
    """
    spark = part.sparkSession
    words = lambda k, c: part.select(c.alias("w")).where(F.length("w") > 0).distinct().select(F.lit(k).alias("k"), "w")
    adj = words("adj", F.lower(F.element_at(F.split("p_name", " "), 1)))
    noun = words("noun", F.lower(F.element_at(F.split("p_name", " "), -1)))
    kind = words("type", F.col("p_type"))
    ref = reference_lexicon()
    rule = lambda df, k, shift, trigger, values: df.select(
        F.lit(k).alias("kind"), F.struct(F.lit(shift).alias("shift"), F.col("w")).alias("ord"), trigger.alias("trigger"), values.alias("values"))
    w, both = F.col("w"), F.array(F.col("w"), F.concat(F.col("w"), F.lit("s")))
    own = F.array(w)
    parts = [rule(noun, "skill", 0, w, both), rule(noun, "skill", 0, F.concat(w, F.lit("s")), both), rule(adj, "role", 0, w, own),
             rule(kind, "tag", 0, F.lower(w), own)]
    for k in ("boost", "token"):
        parts += [rule(noun, k, 0, w, own), rule(adj, k, 1, w, own)]
    parts += [rule(noun, "fb_skill", 0, w, own), rule(adj, "fb_role", 0, w, own)]
    fixed = [("tag", 1, 0, t, list(DERIVED_MULTI_RULE[1])) for t in DERIVED_MULTI_RULE[0]]
    fixed += [("job", 0, i, t, list(vs)) for i, (ts, vs) in enumerate(ref.job_rules) for t in ts]
    few = spark.createDataFrame(fixed, "kind string, shift int, n int, trigger string, values array<string>").select(
        "kind", F.struct("shift", F.format_string("%04d", "n").alias("w")).alias("ord"), "trigger", "values")
    out = few
    for p in parts:
        out = out.unionByName(p)
    return out


def understand_by_rules(queries: DataFrame, rules: DataFrame, text: str = "query", key: str = "query_id", unit_scope: str = "query",
                        **lots) -> DataFrame:
    """The columns of ``understand_queries`` for queries with a unique ``key``; ``ord`` may be of any type that has an order."""
    q = queries.withColumn("q_raw_lower", F.lower(F.col(text))).withColumn("q_clean", qt.clean_query(F.col(text))) \
        .withColumn("q_lower", F.lower(F.col("q_clean"))) \
        .withColumn("q_duration", qt.query_duration(F.col("q_lower"), unit_scope)) \
        .withColumn("q_words", qt.query_words(F.col("q_raw_lower")))
    scanned = rules.where(F.col("kind").isin(*SUBSTRING_KINDS))
    # one pass for both texts of a query: terms are looked for in the raw text and, where it differs, in the clean one
    fields = F.array(F.struct(F.lit("q_lower").alias("field"), F.col("q_lower").alias("text")),
                     F.struct(F.lit("q_raw_lower").alias("field"), F.col("q_raw_lower").alias("text")))
    texts = q.select(key, F.inline(fields)).select(F.struct(key, "field").alias("at"), "text")
    hits = match_terms(texts, scanned, "at", "text", "trigger", **lots).select(
        F.col(f"at.{key}").alias(key), F.col("at.field").alias("field"), F.col("term").alias("trigger"))
    field_of = F.create_map(*[F.lit(x) for kind, (_, field) in SUBSTRING_KINDS.items() for x in (kind, field)])
    found = hits.join(scanned.withColumn("field", field_of[F.col("kind")]), ["field", "trigger"]).select(key, "kind", "ord", "values")
    tokens = q.select(key, F.explode("q_words").alias("trigger")).join(rules.where("kind = 'token'"), "trigger").select(key, "kind", "ord", "values")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("ord", "values")))
    per = found.unionByName(tokens).groupBy(key).agg(*[of(k).alias(f"_{k}") for k in (*SUBSTRING_KINDS, "token")])
    empty = F.array().cast("array<string>")
    in_order = lambda k: F.flatten(F.transform(F.array_sort(f"_{k}"), lambda r: r["values"]))
    values = {name: F.array_distinct(in_order(k)) if k in ONCE else in_order(k) for k, (name, _) in SUBSTRING_KINDS.items()}
    values["boost_tokens"] = F.array_sort(F.array_distinct(in_order("token")))
    named = per.select(key, *[v.alias(c) for c, v in values.items()])
    met = q.join(named, key, "left").withColumns({c: F.coalesce(c, empty) for c in values})
    met = met.withColumn("expanded", qt.expand_query(F.col("q_clean"), F.col("skills"), F.col("roles"), F.col("job_terms")))
    return met.withColumn("expanded_lower", F.lower("expanded"))
