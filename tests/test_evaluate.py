from rankweave.operators import evaluate as H

V = "https://x.com/products/product-catalog/view/"
S = "https://x.com/solutions/products/product-catalog/view/"


def test_recall_counts_distinct_slugs(spark):
    ranked = spark.createDataFrame(
        [(1, V + "a/", [], 1), (1, S + "a/", [], 2), (1, V + "z/", [V + "b/"], 3), (1, V + "c/", [], 11)],
        "query_id long, url string, alternate_urls array<string>, rank int")
    jd = spark.createDataFrame([(1, S + "A/"), (1, V + "b"), (1, V + "c/"), (2, V + "d/")],
                               "query_id long, Assessment_url string")
    per = {r["query_id"]: r for r in H.recall_at_k(ranked, jd, 10).collect()}
    assert per[1]["n_relevant"] == 3 and per[1]["n_hits"] == 2
    assert abs(per[1]["recall"] - 2 / 3) < 1e-12 and per[1]["has_results"]
    assert per[2]["recall"] == 0.0 and not per[2]["has_results"]
    m = H.mean_recall(H.recall_at_k(ranked, jd, 10), "skip").first()
    assert m["n_queries"] == 1
    st = H.recall_stats(H.recall_at_k(ranked, jd, 10)).first()
    assert st["n_zero"] == 1 and st["n_queries"] == 2


def test_compare_strategies_and_misses(spark):
    a = spark.createDataFrame([(1, V + "a/", [], 1)], "query_id long, url string, alternate_urls array<string>, rank int")
    b = spark.createDataFrame([(1, V + "b/", [], 1)], "query_id long, url string, alternate_urls array<string>, rank int")
    jd = spark.createDataFrame([(1, V + "a/"), (1, V + "c/")], "query_id long, Assessment_url string")
    out = {r["strategy"]: r for r in H.compare_strategies({"a": a, "b": b}, jd, 10, baseline="b").collect()}
    assert out["a"]["position"] == 1 and out["a"]["is_best"]
    assert abs(out["a"]["gain_over_baseline"] - 0.5) < 1e-12
    cat = spark.createDataFrame([(1, V + "c/", "C item", [])], "item_id long, url string, name string, alternate_urls array<string>")
    miss = H.miss_analysis(a, jd, cat, 10).collect()
    assert [(r["slug"], r["name"]) for r in miss] == [("c", "C item")]
