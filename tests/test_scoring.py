"""Retrieval, re-ranking and fusion on a hand-made catalogue."""
from pyspark.sql import functions as F

from rankweave.functions.lexicon import Lexicon
from rankweave.operators import rerank as RR
from rankweave.operators.fusion import fuse_rankings
from rankweave.operators.retrieve import hybrid_retrieve
from rankweave.operators.understand import understand_queries

V = "https://x.com/products/product-catalog/view/"
LEX = Lexicon(concepts=(("java", ("java", "jdk")),), roles=(("developer", ("developer",)),),
              tag_rules=((("skill",), ("Knowledge & Skills",)), (("skill", "java"), ("Knowledge & Skills",))),
              stopwords=("the", "for"), entry_query=("entry",), entry_name=("entry",),
              senior_query=("senior",), senior_name=("senior",))


def _items(spark):
    rows = [
        (1, V + "java-8/", "Java 8", "core java skill test", 30, "Yes", "No", ["Knowledge & Skills"], [1.0, 0.0]),
        (2, V + "dev/", "Developer aptitude", "for developer roles", 60, "No", "No", ["Ability & Aptitude"], [0.8, 0.6]),
        (3, V + "entry-java/", "Entry Java", None, None, "Yes", "Yes", ["Knowledge & Skills"], [0.6, 0.8]),
    ]
    return spark.createDataFrame(rows, "item_id long, url string, name string, description string, duration int, "
                                       "remote_support string, adaptive_support string, test_type array<string>, "
                                       "vec array<double>").withColumn("alternate_urls", F.array().cast("array<string>"))


def _queries(spark, text="java skill test for developer, 40 minutes"):
    return understand_queries(spark.createDataFrame([(0, text, [1.0, 0.0])],
                                                    "query_id long, query string, qvec array<double>"), LEX)


def test_hybrid_keyword_score_by_hand(spark):
    h = {r["item_id"]: r for r in hybrid_retrieve(_queries(spark), _items(spark), LEX.stopwords).collect()}
    # item 1: skills java(name .40) jdk(no); roles developer(no); phrase java in expanded & name .20;
    # tags Knowledge & Skills twice (bag) .20 x2; common words {java} .15
    assert abs(h[1]["keyword_score"] - (0.40 + 0.20 + 0.40 + 0.15)) < 1e-9
    assert h[1]["sim"] == 1.0 and h[1]["hybrid_rank"] == 1
    # item 2: developer in name .30; no tags; "developer," (with the comma) is not a name word
    assert abs(h[2]["keyword_score"] - 0.30) < 1e-9


def test_penalties_and_rules(spark):
    c = RR.soft_penalties(hybrid_retrieve(_queries(spark), _items(spark), LEX.stopwords))
    d = {r["item_id"]: r for r in c.collect()}
    # item 2: 60 > 1.3 * 40 -> x0.9 ; no preferred tag -> x0.95
    assert abs(d[2]["combined_score"] - d[2]["hybrid_score"] * 0.9 * 0.95) < 1e-12
    assert d[1]["combined_score"] == d[1]["hybrid_score"]
    r = {x["item_id"]: x for x in RR.rerank_rules(c, LEX).collect()}
    # item 1: java in name .30, duration 30 <= 48 .15, tags .10 x2
    assert abs(r[1]["rerank_score"] - (0.30 + 0.15 + 0.20)) < 1e-9
    assert [x["item_id"] for x in sorted(r.values(), key=lambda x: x["rank"])][0] == 1


def test_fusion_formula(spark):
    a = spark.createDataFrame([(0, "u1", 1, 1, 0.9), (0, "u2", 2, 2, 0.5)],
                              "query_id long, url string, item_id long, rank int, s double")
    b = spark.createDataFrame([(0, "u2", 2, 1, 0.8)], "query_id long, url string, item_id long, rank int, s double")
    out = {r["url"]: r for r in fuse_rankings([("a", a, "s"), ("b", b, "s")], 10).collect()}
    rrf2 = 1 / 62 + 1 / 61
    assert abs(out["u2"]["final_score"] - ((0.8 * 0.7 + 0.5 * 0.3) * 0.7 + rrf2 * 0.3)) < 1e-12
    assert abs(out["u1"]["final_score"] - (0.9 * 0.7 + (1 / 61) * 0.3)) < 1e-12


def test_external_ranking_merge(spark):
    c = RR.soft_penalties(hybrid_retrieve(_queries(spark), _items(spark), LEX.stopwords))
    ranking = spark.createDataFrame(
        [(0, 1, "https://unknown.org/x/"), (0, 2, "https://mirror.org/view/entry-java/"),
         (0, 3, V + "dev/"), (0, 4, V + "dev/")], "query_id long, pos int, url string")
    got = [(r["item_id"], r["from_external"]) for r in
           RR.apply_external_ranking(c, ranking, 3).orderBy("rank").collect()]
    assert got == [(3, True), (2, True), (1, False)]


def _merge(spark, cands, listed, k=4):
    c = spark.createDataFrame([(0, i, u, a, i) for i, (u, a) in enumerate(cands)],
                              "query_id long, item_id long, url string, alternate_urls array<string>, hybrid_rank int")
    r = spark.createDataFrame([(0, p, u) for p, u in enumerate(listed)], "query_id long, pos int, url string")
    return [x["url"].removeprefix(V) for x in RR.apply_external_ranking(c, r, k).orderBy("rank").collect()]


def test_a_partial_match_skips_used_urls_and_reads_alternates(spark):
    cands = [(V + n, []) for n in ("zzz", "java", "yyy", "core-java")]
    assert _merge(spark, cands, [V + "java", "https://mirror.org/view/java"]) == ["java", "core-java", "zzz", "yyy"]
    cands = [(V + "zzz", None), (V + "old", [V + "new-name"])]
    assert _merge(spark, cands, ["https://mirror.org/view/new-name"]) == ["old", "zzz"]
    assert _merge(spark, cands, [V + "new-name", V + "old", V + "old"]) == ["old", "zzz"]
    assert _merge(spark, cands, []) == ["zzz", "old"]


def test_url_queries(spark):
    from rankweave.operators.understand import resolve_url_queries
    q = spark.createDataFrame([(1, "java"), (2, " https://a/x\n"), (3, "https://a/none"), (4, "  "), (5, None), (6, " text "),
                               (7, "https://a/blank")], "query_id long, query string")
    p = spark.createDataFrame([(1, "https://a/x", "<p>first</p>"), (2, "https://a/x", "<p>second</p>"), (3, "java", "<p>no</p>"),
                               (4, "https://a/blank", "")], "page_id long, url string, html string")
    resolved, rejects = resolve_url_queries(q, p)
    assert sorted(map(tuple, resolved.collect())) == [(1, "java"), (2, "first"), (6, "text")]
    assert sorted(r["query_id"] for r in rejects.collect()) == [3, 4, 5, 7]


def test_a_pool_that_is_too_shallow_is_an_error(spark):
    import pytest
    from rankweave.operators.retrieve import candidate_pool, retrieve_basic
    pool = candidate_pool(_queries(spark), _items(spark), 6)
    assert retrieve_basic(_queries(spark), _items(spark), k=2, pool=pool).count() == 2
    with pytest.raises(ValueError, match="pool"):
        retrieve_basic(_queries(spark), _items(spark), k=60, pool=pool)


def test_parse_ranking_response(spark):
    texts = ['```json\n["https://a/1", "https://a/2"]\n```', '["https://a/3"]',
             'see https://a/4, then https://a/5]', '["https://a/6"]}', "[]", 'x ```\n["https://a/7"]\n```']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(RR.parse_ranking_response(F.col("t"))).collect()]
    assert got == [["https://a/1", "https://a/2"], ["https://a/3"], ["https://a/4", "https://a/5"],
                   ['https://a/6"'], [], ["https://a/7"]]   # invalid JSON: regex keeps the quote


def test_url_queries_over_a_union_of_pages(spark):
    """a semi join was pushed below the union, whose parts Spark then took for one partitioning (zip of 200 and 400 parts)."""
    from rankweave.operators.understand import resolve_url_queries
    q = spark.createDataFrame([(1, "https://a/x"), (2, "https://a/y"), (3, "t")], "query_id long, query string")
    p = spark.createDataFrame([(1, "https://a/x", "<p>first</p>"), (5, "https://a/y", "<p>y</p>")], "page_id long, url string, html string")
    older = p.select((-F.col("page_id") - 1).alias("page_id"), "url", F.concat(F.lit("<p>older</p>"), "html").alias("html"))
    resolved, rejects = resolve_url_queries(q, p.unionByName(older))
    assert sorted(map(tuple, resolved.collect())) == [(1, "olderfirst"), (2, "oldery"), (3, "t")] and rejects.count() == 0
    assert "LeftSemi" not in resolved._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_ranked_narrow_and_repeated_ids_keep_their_own_rows(spark):
    """What is ranked holds ids and scores only; the rest is joined by id and row."""
    from rankweave.operators.retrieve import NARROW, hybrid_scores, with_items, with_queries
    items, uq = _items(spark), _queries(spark)
    twice = items.unionByName(items)
    other = items.limit(1).withColumn("url", F.concat("url", F.lit("other/")))
    for cat, copies in ((items, 1), (twice, 2), (items.unionByName(other), None)):
        narrow = hybrid_scores(uq, cat, LEX.stopwords, k=1000, also={"x": F.lit(1.0)})
        assert narrow.columns == [*NARROW, "x", "hybrid_rank"]
        whole = with_queries(with_items(narrow, cat), uq)
        assert whole.count() == narrow.count() and set(uq.columns) - {"qvec"} & set(whole.columns)
        if copies:
            assert narrow.count() == copies ** 2 * hybrid_scores(uq, items, LEX.stopwords, k=1000).count()
        else:
            assert whole.select("url").distinct().count() == cat.select("url").distinct().count()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_vectors_norm_is_summed_once(spark):
    from rankweave.functions.vectors import l2_normalize
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None])], "i int, v array<float>")
    out = df.select("i", l2_normalize(F.col("v")).alias("n"))
    assert _optimized(out).count("aggregate(") == 1
    assert {r.i: r.n for r in out.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [], 5: [None, None]}


def test_scores_of_a_pair_are_made_once(spark):
    """Lambdas that stand in two columns are computed twice, so each score is a column that the others read."""
    from rankweave.operators.rerank import combined_score, rule_scores
    from rankweave.operators.retrieve import Pool, hybrid_scores
    lex = Lexicon()
    uq = understand_queries(spark.createDataFrame([(1, "need brass rod")], "query_id long, query string"), lex)
    items = spark.createDataFrame([(7, "u", "brass rod", None, 5, "Yes", "No", ["A"], [], [1.0])], "item_id long, url string, name string, "
                                  "description string, duration int, remote_support string, adaptive_support string, test_type array<string>, "
                                  "alternate_urls array<string>, vec array<double>")
    pool = Pool(spark.createDataFrame([(1, 7, 0.5, 1)], "query_id long, item_id long, sim double, sem_rank int"), 150)
    scored = hybrid_scores(uq, items, lex.stopwords, pool=pool, also={"combined_score": combined_score(), **rule_scores(lex, F.col("_name"))})
    assert "_rule" not in scored.columns and "_kw" not in scored.columns
    assert _optimized(scored).count("array_intersect(_words") == 1
    row, = scored.collect()
    assert (row.keyword_score, row.hybrid_score, row.final_score) == (0.3, 0.8, row.combined_score + row.rerank_score)
