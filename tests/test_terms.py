"""Terms of a table in texts: the automaton and the gram lists against plain substring tests."""
import random

from pyspark.sql import functions as F

from rankweave.functions.lexicon import derive_lexicon, reference_lexicon
from rankweave.operators import terms as M
from rankweave.operators.lexicon_table import derive_rules, rules_of, understand_by_rules
from rankweave.operators.understand import understand_queries

ALPHABET = "abcdé 中"


def _random(rng, n, longest):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def _frames(spark, texts, terms):
    return (spark.createDataFrame(list(enumerate(texts)), "id long, text string"),
            spark.createDataFrame([(t,) for t in terms], "term string"))


def _want(texts, terms):
    return sorted({(i, t) for i, x in enumerate(texts) for t in terms if x and t and t in x})


def test_both_ways_find_what_contains_finds(spark):
    rng = random.Random(3)
    texts = _random(rng, 120, 30) + [None, "", "a"]
    terms = _random(rng, 150, 6) + [None, "", "a", "a", "zzz", "b" * 40]
    want = _want(texts, terms)
    a, b = _frames(spark, texts, terms)
    rows = lambda df: sorted((r["id"], r["term"]) for r in df.collect())
    assert rows(M.match_terms(a.repartition(3), b, "id")) == want and len(want) > 300
    assert rows(M.match_terms(a, b, "id", lot_bytes=100)) == want       # many lots
    assert rows(M.contains_join(a.repartition(3), b, "id")) == want
    for empty in (M.match_terms(a.limit(0), b, "id"), M.match_terms(a, b.limit(0), "id"), M.contains_join(a.limit(0), b, "id"),
                  M.contains_join(a, b.limit(0), "id")):
        assert empty.count() == 0


def test_half_a_million_terms(spark):
    terms = spark.range(500_000).select(F.concat(F.lit("term"), F.col("id"), F.lit("x")).alias("term"))
    texts = spark.range(300).select("id", F.concat(F.lit("a term"), F.col("id") * 1777, F.lit("x and a term7x, term"), F.col("id")).alias("text"))
    got = {(r["id"], r["term"]) for r in M.match_terms(texts, terms, "id").collect()}
    want = {(k, f"term{n}x") for k in range(300) for n in (k * 1777, 7) if n < 500_000}
    assert got == want


def _same(a, b, cols):
    rows = lambda df: sorted(map(repr, df.select("query_id", *cols).collect()))
    assert rows(a) == rows(b)


COLS = ("q_lower", "q_duration", "skills", "roles", "tag_prefs", "job_terms", "expanded", "boost_terms", "boost_tokens", "q_words", "fb_skills", "fb_roles")


def test_rules_understand_like_the_inline_lexicon(spark):
    texts = ["Senior Java developer, 40 minutes", "entry level SALES  manager consultant", "", None, "nothing here", "QA testing html/css 2 hours",
             "numerical and verbal reasoning for graduate analysts; data science"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    lex = reference_lexicon()
    _same(understand_by_rules(q, rules_of(spark, lex)), understand_queries(q, lex).withColumns(
        {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("skills", "roles", "tag_prefs", "job_terms", "boost_terms", "boost_tokens", "fb_skills", "fb_roles")}), COLS)


def test_derived_rules_are_the_derived_lexicon(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    q = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("a Senior "), "p_name", F.lit("s kit, "), "p_type", F.lit(" 30 mins")).alias("query"))
    _same(understand_by_rules(q, derive_rules(part)), understand_queries(q, derive_lexicon(part)), COLS)
