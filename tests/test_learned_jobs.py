"""Jobs of the learned ranker: candidates are scanned and scored once."""
import pytest

from paths import SF_SMALL


@pytest.mark.parametrize("name", ["g4_saved_ranker", "g5_rerank_one_split", "h10_learned"])
def test_learned_jobs_scan_and_score_candidates_once(spark, monkeypatch, name):
    """Training pairs and the rows that the model ranks are the same candidates."""
    from rankweave.operators import retrieve as R
    from rankweave.plans import jobs_learn
    scans = []
    monkeypatch.setattr(R, "knn_topk", lambda *a, f=R.knn_topk, **k: scans.append(1) or f(*a, **k))
    df = getattr(jobs_learn, name)(spark, SF_SMALL)
    assert len(scans) == 1 and "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_label_variants_come_from_the_items(spark):
    from rankweave.operators.learn import label_candidates
    from rankweave.operators.relevance import from_pairs
    url = "https://shop.example.com/products/product-catalog/view/{}/"
    items = spark.createDataFrame([(k, url.format(f"i{k % 3}"), [url.format(f"alt{k}")] if k % 2 else None) for k in range(6)] * 2 + [(9, None, None)],
                                  "item_id long, url string, alternate_urls array<string>")
    cands = items.distinct().crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"))
    judged = from_pairs(spark.createDataFrame([(1, url.format("i1")), (2, url.format("alt5")), (2, url.format("x"))], "query_id long, Assessment_url string"))
    rows = lambda df: sorted((r.query_id, r.item_id, r.label) for r in df.collect())
    got = rows(label_candidates(cands, judged, items))
    assert got == rows(label_candidates(cands, judged)) and len(got) == 14
    assert [(q, i) for q, i, label in got if label] == [(1, 1), (1, 4), (2, 5)]
