from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import pages as P

PAGE = ('<html><head><title>Thing | Site extra</title><meta content="Meta &amp; desc" name="description">'
        '<script>var s="</p><h1>no</h1>";</script><style>p{}</style></head><body><!-- 9 minutes -->'
        '<h1> <b>Real</b> Name </h1><p>short</p><p>A paragraph that is certainly longer than fifty characters in total.</p>'
        '<p>Takes 2 hours online, adaptive. Knowledge &amp; Skills</p></body></html>')


def _sel(spark, *exprs):
    return spark.createDataFrame([(PAGE,)], "html string").select(*exprs).first()


def test_name_description_duration_flags_tags(spark):
    text = T.page_text(F.col("html"))
    remote, adaptive = T.extract_flags(text)
    r = _sel(spark, T.extract_name(F.col("html")).alias("n"), T.extract_description(F.col("html")).alias("d"),
             T.extract_duration(text).alias("m"), remote.alias("r"), adaptive.alias("a"),
             T.classify_tags(text).alias("t"))
    assert r["n"] == "Real Name"
    assert r["d"] == "Meta & desc"
    assert r["m"] == 120                      # the commented "9 minutes" is not page text
    assert (r["r"], r["a"]) == ("Yes", "Yes")
    assert r["t"] == ["Knowledge & Skills"]


def test_name_falls_back_to_title_and_description_to_paragraph(spark):
    html = '<title>Only Title | Site</title><p>x</p><p>' + "y" * 60 + "</p>"
    r = spark.createDataFrame([(html,)], "html string").select(
        T.extract_name(F.col("html"), site="Site").alias("n"), T.extract_description(F.col("html"), 20).alias("d")).first()
    assert r["n"] == "Only Title" and r["d"] == "y" * 20


def test_tag_rules_and_codes(spark):
    df = spark.createDataFrame([("cognitive trait",), ("nothing here",), ("AKX P",)], "t string")
    got = [r[0] for r in df.select(T.classify_tags(F.col("t"))).collect()]
    assert got[0] == ["Ability & Aptitude", "Personality & Behavior"] and got[1] == ["Unknown"]
    codes = df.select(T.decode_tag_codes(F.col("t"), "char").alias("c"), T.decode_tag_codes(F.col("t"), "token").alias("k")).collect()
    assert codes[2]["c"] == ["Ability & Aptitude", "Knowledge & Skills", "Personality & Behavior"]
    assert codes[2]["k"] == ["Personality & Behavior"]


def test_html_to_text_and_boilerplate(spark):
    html = "<p>Line one  chunk</p>\n  <p> two </p><script>x</script>About Us: it is an equal opportunity employer. Tail"
    r = spark.createDataFrame([(html,)], "html string").select(
        T.html_to_text(F.col("html")).alias("t"),
        T.strip_boilerplate(T.html_to_text(F.col("html")), T.REFERENCE_BOILERPLATE).alias("s")).first()
    assert r["t"] == "Line one chunk two About Us: it is an equal opportunity employer. Tail"
    assert r["s"] == "Line one chunk two  Tail"


def test_links_json_rows(spark):
    pages = spark.createDataFrame([(1, "https://h.org/a/b.html",
                                    '<a href="/x/view/1">1</a><a class=z href=\'rel/view/2\'>2</a><a href="https://o.org/view/3?a=1&amp;b=2">3</a><a href="/skip">')],
                                  "page_id long, url string, html string")
    links = sorted(r[0] for r in P.extract_links(pages).collect())
    assert links == ["https://h.org/a/rel/view/2", "https://h.org/x/view/1", "https://o.org/view/3?a=1&b=2"]
    js = spark.createDataFrame([('{"a": {"https://k/view/key": "https://v/view/1"}, "l": ["https://v/view/2", 3]}',),
                                ('{"bad": "https://v/view/9"}}',)], "json string")
    assert sorted(r[0] for r in P.extract_json_urls(js).collect()) == ["https://v/view/1", "https://v/view/2"]
    listing = spark.createDataFrame([(
        '<table><tr data-entity-id="7"><td><a href="/p/view/x/">X &amp; Y</a></td><td><img></td><td></td><td>K P</td></tr>'
        '<tr data-entity-id="8"><td>no link</td><td></td><td></td><td>A</td></tr><tr data-entity-id="9"><td>a</td></tr></table>',)],
        "html string")
    rows = P.parse_catalog_rows(listing, site="https://s.com").collect()
    assert [(r["entity_id"], r["url"], r["name"], r["remote_support"], r["adaptive_support"], r["test_type"]) for r in rows] == \
        [("7", "https://s.com/p/view/x/", "X & Y", "Yes", "No", ["Knowledge & Skills", "Personality & Behavior"])]


def test_pagination_grid_is_generated_without_joins(spark):
    grid = P.pagination_grid(["https://s.com/a/", "https://s.com/b/"], stop=48, step=12, spark=spark)
    rows = grid.collect()
    assert len(rows) == 2 * 4 * 2
    assert "https://s.com/b/?start=36&type=2" in {r["url"] for r in rows}
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_tables_inside_tables(spark):
    html = ("<p>x<table a><tr><td>one<table><tr><td>two</table>three</td></tr></table>y<TABLE><tr></tr>"
            "</TABLE></table><table>open")
    got = spark.createDataFrame([(html,), ("no tables",), (None,), ("",)], "html string").select(P.table_texts(F.col("html")).alias("t")).collect()
    assert got[0]["t"] == ["<table><tr><td>two</table>", "<table a><tr><td>onethree</td></tr></table>", "<TABLE><tr></tr></TABLE>"]
    assert got[1]["t"] == [] and got[2]["t"] is None and got[3]["t"] == []


def test_durations_flags_and_tags_of_detail_pages(spark):
    texts = ["Duration: 45", "Time 30 or 20 minutes", "Assessment Length: 12", "5 mins", "Time: 8", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.extract_duration(F.col("t"), T.TIME_DURATIONS), T.extract_duration(F.col("t"), T.LENGTH_DURATIONS)).collect()
    assert [tuple(r) for r in got] == [(45, 45), (20, 20), (None, 12), (5, 5), (8, None), (None, None), (None, None)]
    flags = spark.createDataFrame([("Taken Online!",), ("onlineshop éonline",), ("IRT-based",), ("birth",)], "t string").select(
        *T.extract_flags(F.col("t"), T.DETAIL_REMOTE_WORDS, T.DETAIL_ADAPTIVE_WORDS, True),
        T.extract_flags(F.col("t"), T.DETAIL_REMOTE_WORDS, T.DETAIL_ADAPTIVE_WORDS, True, "Yes")[0]).collect()
    assert [tuple(r) for r in flags] == [("Yes", "No", "Yes"), ("No", "No", "Yes"), ("No", "Yes", "Yes"), ("No", "No", "Yes")]
    tags = spark.createDataFrame([("verbal feedback",), ("nothing",), ("Simulations and verbal",)], "t string").select(
        T.classify_tags(F.col("t"), rules=T.CATEGORY_TABLE, unknown=None)).collect()
    assert [r[0] for r in tags] == [["Ability & Aptitude", "Development & 360"], [], ["Simulations"]]
