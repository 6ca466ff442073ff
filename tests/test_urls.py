from pyspark.sql import functions as F

from rankweave.functions import urls as U

LONG = "https://x.com/solutions/products/product-catalog/view/"
SHORT = "https://x.com/products/product-catalog/view/"


def _one(spark, expr_fn, values):
    df = spark.createDataFrame([(v,) for v in values], "u string")
    return [r[0] for r in df.select(expr_fn(F.col("u"))).collect()]


def test_url_to_slug_hand_cases(spark):
    got = _one(spark, U.url_to_slug, [
        None, "", "  ", SHORT + "Java-8-%28New%29/", SHORT + "a%20b%2Dc//", "https://x.com/about/",
        "https://x.com/a/view/b/view/Last/", " HTTPS://X.COM/VIEW/Mixed ",
    ])
    assert got == ["", "", "", "java-8-(new)", "a b-c", "https://x.com/about",
                   "last", "mixed"]


def test_alternate_url_swaps_prefixes_case_sensitively(spark):
    got = _one(spark, U.alternate_url, [LONG + "a/", SHORT + "a/", "https://x.com/other/", None, "",
                                        "https://x.com/SOLUTIONS/products/product-catalog/view/a/"])
    assert got == [SHORT + "a/", LONG + "a/", "https://x.com/other/", None, "",
                   "https://x.com/SOLUTIONS/products/product-catalog/view/a/"]


def test_url_for_comparison(spark):
    got = _one(spark, U.url_for_comparison, [LONG + "A%28b%29/", None, "https://x.com/Z%2d/"])
    assert got == [SHORT.lower() + "a(b)", "", "https://x.com/z-"]


def test_variants_and_match(spark):
    df = spark.createDataFrame([(LONG + "a/", ["https://m.org/view/b/"]), (SHORT + "c/", None)],
                               "url string, alts array<string>")
    got = [r[0] for r in df.select(U.url_variants(F.col("url"), F.col("alts"))).collect()]
    assert got == [["a", "b"], ["c"]]
    m = df.select(U.urls_match(U.url_variants(F.col("url"), F.col("alts")),
                               F.array(F.lit("b")))).collect()
    assert [r[0] for r in m] == [True, False]
