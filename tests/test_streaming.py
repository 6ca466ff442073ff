import __spark_entry__ as E
from paths import SF_SMALL


def test_stream_equals_batch(spark):
    jobs = E.queries()
    cols = ["query_id", "rank", "item_id", "url", "final_score"]
    stream = sorted(tuple(r) for r in jobs["K1_recommend_stream"](spark, SF_SMALL).select(*cols).collect())
    batch = sorted(tuple(r) for r in jobs["F8_recommend_rules"](spark, SF_SMALL).select(*cols).collect())
    assert stream == batch and len(batch) > 0


def test_ingest_stream_keeps_one_row_per_url(spark):
    df = E.queries()["K2_ingest_pages_stream"](spark, SF_SMALL)
    assert df.count() == df.select("url").distinct().count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "final_score" in df.columns
