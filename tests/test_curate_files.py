import uuid

from pyspark.sql import functions as F

from rankweave.operators import curate as C
from rankweave.session import scratch_path
from rankweave.sources import files as FS

V = "https://x.com/products/product-catalog/view/"
S = "https://x.com/solutions/products/product-catalog/view/"


def test_add_alternates_and_packaged(spark):
    df = spark.createDataFrame([(V + "a/", None), (S + "b/", [V + "b/"]), ("https://x.com/pre-packaged/c", [])],
                               "url string, alternate_urls array<string>")
    got = [r["alternate_urls"] for r in C.add_alternates(df).orderBy("url").collect()]
    assert got == [[], [S + "a/"], [V + "b/"]]
    assert C.drop_packaged(df).count() == 2


def test_dedupe_keep_first_last_on_hot_url(spark):
    rows = [(V + "hot/", i, f"v{i}") for i in range(50)] + [(V + "cold/", 7, "only")]
    df = spark.createDataFrame(rows, "url string, seq int, name string").repartition(5)
    first = {r["url"]: r["name"] for r in C.dedupe_by_url(df, "seq", "first").collect()}
    last = {r["url"]: r["name"] for r in C.dedupe_by_url(df, "seq", "last").collect()}
    assert first == {V + "hot/": "v0", V + "cold/": "only"}
    assert last == {V + "hot/": "v49", V + "cold/": "only"}


def test_merge_detail_prefers_base_name_and_tags(spark):
    base = spark.createDataFrame([(V + "a/", "", None, None, "No", None, []), (V + "b/", "B", None, None, None, "Yes", ["K"])],
                                 "url string, name string, description string, duration bigint, remote_support string, "
                                 "adaptive_support string, test_type array<string>")
    detail = spark.createDataFrame([(V + "a/", "A page", "desc", 30, ["P"])],
                                   "url string, name string, description string, duration bigint, test_type array<string>")
    out = {r["url"]: r for r in C.merge_detail(base, detail).collect()}
    a, b = out[V + "a/"], out[V + "b/"]
    assert (a["name"], a["description"], a["duration"], a["remote_support"], a["adaptive_support"], a["test_type"]) == \
        ("A page", "desc", 30, "No", "No", ["P"])
    assert (b["name"], b["remote_support"], b["test_type"]) == ("B", None, ["K"])   # no detail: base row as is


def test_add_missing_and_coverage(spark):
    cat = spark.createDataFrame([(V + "a/", [S + "a/"])], "url string, alternate_urls array<string>")
    judged = spark.createDataFrame([(S + "a/",), (V + "New-One/",)], "Assessment_url string")
    pages = spark.createDataFrame([(V + "New-One/", "<h1>New one</h1><main><p>" + "d" * 60 + "</p></main> cognitive")],
                                  "url string, html string")
    m = C.add_missing(cat, judged, pages).collect()
    assert [(r["url"], r["name"], r["description"], r["test_type"], r["alternate_urls"]) for r in m] == \
        [(V + "New-One/", "New one", "d" * 60, ["Ability & Aptitude"], [S + "New-One/"])]
    cov = C.coverage(judged, cat).first()
    assert (cov["n_judged_slugs"], cov["n_covered"], cov["n_missing"], cov["n_items"], cov["n_with_alternates"]) == (2, 1, 1, 1, 1)
    assert C.completeness_gate(cat.withColumn("name", F.lit("x")), min_items=2).first()["passed"] is False


def test_versioned_rewrite_and_materialize(spark):
    root = scratch_path(spark, f"t-{uuid.uuid4().hex}")
    v1 = spark.createDataFrame([(1, "a")], "id int, v string")
    FS.write_versioned(v1, root)
    FS.write_versioned(FS.read_current(spark, root).withColumn("v", F.lit("b")), root)
    assert FS.current_version(spark, root) == 2
    assert [r["v"] for r in FS.read_current(spark, root).collect()] == ["b"]
    assert [r["v"] for r in FS.read_current(spark, root, version=1).collect()] == ["a"]     # backup kept
    calls = []
    path = scratch_path(spark, f"m-{uuid.uuid4().hex}")
    FS.materialize(lambda: calls.append(1) or v1, spark, path)
    FS.materialize(lambda: calls.append(1) or v1, spark, path)
    assert len(calls) == 1


def test_csv_round_trip_and_incremental(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.createDataFrame([(' q1 "multi"\nline ', V + "A/"), ("q1", V + "a"), ("q2", S + "b/")],
                          "Query string, Assessment_url string").write.option("header", True).option("escape", '"').csv(path)
    rows = sorted((r["Query"], r["slug"]) for r in FS.read_judgments(spark, path).collect())
    assert rows == [("q1", "a"), ('q1 "multi"\nline', "a"), ("q2", "b")]   # quoted multi-line cell kept whole
    new = spark.createDataFrame([(V + "a/",), (V + "b/",)], "url string")
    done = spark.createDataFrame([(V + "a/", "has text"), (V + "b/", "  ")], "url string, description string")
    assert [r["url"] for r in FS.incremental_catalog(new, done).collect()] == [V + "b/"]
