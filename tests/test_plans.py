"""Plan audit: no registered job may plan a cross join or a nested-loop join,
and the exact k-NN must reduce with a partial top-k before its shuffle."""
import pytest

import __spark_entry__ as E
from paths import SF_SMALL

SKIP = {"G3_train_ranker", "G3_feature_importances", "G5_rerank_learned", "K1_recommend_stream", "K2_ingest_pages_stream"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name} plans a {bad}"


def test_knn_partial_topk_before_shuffle(spark):
    df = E.queries()["E6_knn_top10"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "MapInArrow" in text and "REPARTITION_BY_NUM" in text.upper()
