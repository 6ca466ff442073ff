"""Classes of relevance against the same judgments as pairs."""
from rankweave.operators import evaluate as H
from rankweave.operators import relevance as R

V = "https://x.com/products/product-catalog/view/"


def _classes(spark):
    """Two classes; c1 holds two members of one slug, and a member without a query."""
    queries = [(k, "c1", k) for k in (1, 2, 3)] + [(7, "c2", 7), (8, "c2", None), (9, "c3", 9)]
    members = [("c1", 1, V + "a/"), ("c1", 2, V + "b/"), ("c1", 3, V + "A"), ("c1", 4, V + "d/"), ("c2", 7, V + "a/"), ("c3", 9, V + "z/")]
    return R.Relevance(spark.createDataFrame(queries, "query_id long, class_id string, own long"),
                       spark.createDataFrame(members, "class_id string, member long, url string"))


def _ranked(spark):
    rows = [(1, V + "a/", 1), (1, V + "d/", 2), (2, V + "b/", 1), (2, V + "a", 2), (3, V + "q/", 1), (7, V + "a/", 1), (8, V + "a/", 1)]
    return spark.createDataFrame([(q, u, [], r) for q, u, r in rows], "query_id long, url string, alternate_urls array<string>, rank int")


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pairs_leave_out_the_own_member(spark):
    pairs = _rows(_classes(spark).pairs(), "query_id", "slug")
    assert pairs == [(1, "a"), (1, "b"), (1, "d"), (2, "a"), (2, "a"), (2, "d"), (3, "a"), (3, "b"), (3, "d"), (8, "a")]


def test_classes_and_pairs_give_the_same_recall(spark):
    rel = _classes(spark)
    pairs = rel.pairs().select("query_id", "Assessment_url")
    cols = ("query_id", "n_relevant", "n_hits", "has_results", "recall")
    got = _rows(H.recall_at_k(_ranked(spark), rel, 10), *cols)
    assert got == _rows(H.recall_at_k(_ranked(spark), pairs, 10), *cols)
    # query 2's own slug b doesn't count, query 1's slug a does: member 3 has it as well
    assert got == [(1, 3, 2, True, 2 / 3), (2, 2, 1, True, 1 / 2), (3, 3, 0, True, 0.0), (8, 1, 1, True, 1.0)]


def test_totals_are_the_counted_misses(spark):
    rel, cat = _classes(spark), spark.createDataFrame([(1, V + "d/", "D", [])], "item_id long, url string, name string, alternate_urls array<string>")
    listed = H.miss_analysis(_ranked(spark), rel, cat, 10).groupBy("slug", "name").count()
    counted = H.missed_totals(_ranked(spark), rel, cat, 10).groupBy("slug", "name").sum("n_missed")
    assert _rows(listed, "slug", "name", "count") == _rows(counted, "slug", "name", "sum(n_missed)") != []
    pairs = rel.pairs().select("query_id", "Assessment_url")
    again = H.missed_totals(_ranked(spark), pairs, cat, 10).groupBy("slug", "name").sum("n_missed")
    assert _rows(again, "slug", "name", "sum(n_missed)") == _rows(counted, "slug", "name", "sum(n_missed)")


def test_judged_urls(spark):
    got = _rows(R.judged_urls(_classes(spark)), "Assessment_url", "n_queries")
    assert got == [(V + "A", 2), (V + "a/", 3), (V + "b/", 2), (V + "d/", 3)]


def test_rows_grow_with_members_not_with_pairs(spark):
    n = 300
    rel = R.Relevance(spark.range(n).selectExpr("id AS query_id", "'c' AS class_id", "id AS own"),
                      spark.range(n).selectExpr("'c' AS class_id", "id AS member", f"concat('{V}', id, '/') AS url"))
    ranked = spark.range(n).selectExpr("id AS query_id", f"concat('{V}', (id + 1) % {n}, '/') AS url", "CAST(array() AS array<string>) AS alternate_urls", "1 AS rank")
    assert R.class_slugs(rel).count() == n and H.ranked_slugs(ranked, 10).count() == n
    per = H.recall_at_k(ranked, rel, 10)
    assert per.where("n_relevant = 299 AND n_hits = 1").count() == n
    assert R.missed_by(rel, H.ranked_slugs(ranked, 10)).where("n_missed = 298").count() == n


def test_depth_lists_are_prefixes_of_the_pool(spark):
    import random
    rng = random.Random(1)
    rows = [(q, s, q * 100 + s, rng.choice([0.1, 0.2, 0.3]), f"u{s}", ["x"]) for q in (1, 2) for s in range(1, 91 if q == 1 else 5)]
    scored = spark.createDataFrame(rows, "query_id long, sem_rank int, item_id long, score double, url string, alternate_urls array<string>")
    got = _rows(H.depth_lists(scored.repartition(3), (10, 3, 30), 5), "depth", "query_id", "rank", "item_id")
    want = []
    for depth in (3, 10, 30):
        for q in (1, 2):
            pool = sorted((r for r in rows if r[0] == q and r[1] <= 3 * depth), key=lambda r: (-r[3], r[1], r[2]))
            want += [(depth, q, k, r[2]) for k, r in enumerate(pool[:min(depth, 5)], 1)]
    assert got == sorted(want)


def test_judged_items_lists_every_judgment(spark):
    """one row for each (query, URL, item); before, queries were only counted."""
    rel = _classes(spark)
    more = R.Relevance(rel.queries.unionByName(spark.createDataFrame([(8, "c1", 2)], rel.queries.schema)), rel.members)
    items = spark.createDataFrame([(V + "a/", 70), (V + "a/", 70), (V + "d/", 71)], "url string, item_id long")
    for r in (rel, more):
        got = _rows(R.judged_items(r, items), "query_id", "Assessment_url", "item_id")
        urls = {(p["query_id"], p["Assessment_url"]) for p in r.pairs().collect()}
        assert got == sorted((q, u, i) for q, u in urls for v, i in ((V + "a/", 70), (V + "d/", 71)) if u == v) != []


def test_union_discovery_counts_every_judgment(spark):
    """a URL counts as often as it is judged, without a row for each time; before, once."""
    from rankweave.operators.curate import union_discovery
    rel = _classes(spark)
    judged = R.judged_urls(rel).selectExpr("Assessment_url AS url", "n_queries AS n_rows")
    links = spark.createDataFrame([(V + "a/",), (V + "a/",), ("x",)], "url string")
    _, counts = union_discovery({"links": links, "judged": judged})
    assert _rows(counts, "source", "n_rows", "n_distinct") == [("ALL", 13, 5), ("judged", rel.pairs().count(), 4), ("links", 3, 2)]


def test_read_judgments_job_reads_every_query(spark):
    """all queries' judgments are written and read; before, one query of each label."""
    from paths import SF_SMALL
    from rankweave.plans.jobs import Ctx
    from rankweave.plans.jobs_catalog import a1_read_judgments
    c = Ctx(spark, SF_SMALL)
    asked = c.relevance().pairs().join(c.qry.select("query_id", "query"), "query_id").select("query", "slug").distinct()
    assert a1_read_judgments(spark, SF_SMALL).count() == asked.count() > 0


def test_misses_are_not_shuffled_as_pairs(spark):
    """the listed judgments of a class are dealt over tasks, and no exchange moves them."""
    rel, cat = _classes(spark), spark.createDataFrame([(1, V + "d/", "D", [])], "item_id long, url string, name string, alternate_urls array<string>")
    listed = H.miss_analysis(_ranked(spark), rel, cat, 10)
    got = _rows(listed, "query_id", "slug", "name", "n_hits")
    assert got == [(1, "b", "Unknown", 2), (2, "d", "D", 1), (3, "a", "Unknown", 0), (3, "b", "Unknown", 0), (3, "d", "D", 0)]
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
