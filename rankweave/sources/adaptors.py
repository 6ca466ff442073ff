"""Adaptor views: catalogue, query and judgment tables built from the input tables.

These only shape rows into the schemas the operators expect; none of the
retrieval, scoring or evaluation work happens here, and no operator relies on
how these rows are composed.

* ``catalog``   -- ``part`` joined with ``embeddings`` (one item per vector)
* ``queries``   -- one free-text query per catalogue item, carrying that item's vector
* ``relevance`` -- classes of judged items: a query judges the items with its label, its own excepted
* ``pages``     -- raw HTML pages
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import LONG_PREFIX, SHORT_PREFIX, alternate_url
from ..functions.vectors import l2_normalize
from ..operators.relevance import Relevance
from .tables import table

# Fixed values of the stand-in catalogue: host and the query phrasings
# (chosen by item key so every duration form occurs).
HOST = "https://shop.example.com"


def catalog(spark: SparkSession, sf_dir: str, normalise: bool = True) -> DataFrame:
    """Catalogue items with the original item schema plus ``item_id``, ``vec`` and ``label``."""
    part = table(spark, sf_dir, "part")
    emb = table(spark, sf_dir, "embeddings")
    p = part.join(emb, part["p_partkey"] == emb["vec_id"], "inner")
    key = F.col("p_partkey")
    base = F.when(key % 2 == 0, F.lit(HOST + SHORT_PREFIX)).otherwise(F.lit(HOST + LONG_PREFIX))
    url = F.concat(base, F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"),
                   key.cast("string"), F.lit("/"))
    adjective = F.element_at(F.split("p_name", " "), 1)
    vec = l2_normalize(F.col("embedding")) if normalise else F.col("embedding")
    return (p.select(
        key.alias("item_id"),
        url.alias("url"),
        F.col("p_name").alias("name"),
        F.when(key % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("for "), F.lower("p_type"), F.lit(" work; "), F.col("p_brand"),
                             F.lit(" "), adjective, F.lit(" finish"))).alias("description"),
        F.when(key % 11 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")).alias("duration"),
        F.when(key % 2 == 0, "Yes").otherwise("No").alias("remote_support"),
        F.when(key % 3 == 0, "Yes").otherwise("No").alias("adaptive_support"),
        F.when(key % 13 == 0, F.array(F.col("p_type"), F.lit("Unknown")))
         .otherwise(F.array(F.col("p_type"))).alias("test_type"),
        vec.alias("vec"),
        F.col("label"))
        .withColumn("alternate_urls",
                    F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>"))
                     .otherwise(F.array(alternate_url(F.col("url"))))))


def queries(spark: SparkSession, sf_dir: str, cat: DataFrame | None = None) -> DataFrame:
    """One query per catalogue item: (query_id, query, qvec, label)."""
    cat = cat if cat is not None else catalog(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    c = cat.select("item_id", "name", "vec", "label").join(
        part, F.col("item_id") == F.col("p_partkey"), "inner")
    kind = F.col("item_id") % 5
    ptype = F.lower("p_type")
    size = F.col("p_size").cast("string")
    noun = F.element_at(F.split("name", " "), -1)
    text = (F.when(kind == 0, F.concat(F.lit("need "), F.col("name"), F.lit(" for "), ptype,
                                       F.lit(" work, max "), size, F.lit(" minutes")))
             .when(kind == 1, F.concat(F.lit("looking for a "), F.col("name"), F.lit(", about "),
                                       size, F.lit(" mins, "), ptype, F.lit(" grade")))
             .when(kind == 2, F.concat(F.col("name"), F.lit(" kit for "), ptype, F.lit(" use in "),
                                       size, F.lit("-"), (F.col("p_size") + 10).cast("string"),
                                       F.lit(" minutes")))
             .when(kind == 3, F.concat(F.lit("senior "), noun, F.lit(" for "), ptype,
                                       F.lit(" tasks within 1 hour")))
             .otherwise(F.concat(F.lit("entry level  "), F.col("name"), F.lit("  for remote "),
                                 ptype, F.lit(" jobs"))))
    return c.select(F.col("item_id").alias("query_id"), text.alias("query"),
                    F.col("vec").alias("qvec"), "label")


def relevance(spark: SparkSession, sf_dir: str, cat: DataFrame | None = None,
              qry: DataFrame | None = None, also: tuple[str, ...] = ()) -> Relevance:
    """A query judges all items with its label but its own item; items with odd ids by their alternate URL.

    ``also`` names columns of the queries that are kept beside the class.
    """
    cat = cat if cat is not None else catalog(spark, sf_dir)
    qry = qry if qry is not None else queries(spark, sf_dir, cat)
    url = F.when((F.col("item_id") % 2 == 1) & (F.size("alternate_urls") > 0),
                 F.try_element_at("alternate_urls", F.lit(1))).otherwise(F.col("url"))
    return Relevance(qry.select("query_id", F.col("label").alias("class_id"), F.col("query_id").alias("own"), *also),
                     cat.select(F.col("label").alias("class_id"), F.col("item_id").alias("member"), url.alias("url")))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the catalogue's schema: the first line is the name, the whole text the description."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"),
                    F.concat(F.lit(HOST + "/documents/view/"), F.col("doc_id").cast("string"), F.lit("/")).alias("url"),
                    F.substring_index("text", "\n", 1).alias("name"), F.col("text").alias("description"),
                    F.lit(None).cast("int").alias("duration"), F.lit("No").alias("remote_support"),
                    F.lit("No").alias("adaptive_support"), F.array("lang").alias("test_type"),
                    F.array().cast("array<string>").alias("alternate_urls"))


# ---------------------------------------------------------------- composed documents
# Stand-in inputs for the page jobs whose source documents the driver tables do
# not contain (listing pages, detail pages, sitemaps, robots files, JSON
# payloads). They are built row by row from the catalogue; every page groups a
# bounded number of items (LISTING_PAGE_SIZE).

LISTING_PAGE_SIZE = 12
# Category letters shown per item type on listing pages.
TYPE_CODES = (("ECONOMY", "AK"), ("LARGE", "P"), ("MEDIUM", "KS"), ("PROMO", "B"), ("SMALL", "CD"),
              ("STANDARD", "E"))
IMG = '<span class="yes"><img src="/y.png" alt="yes"></span>'


def _path(url):
    return F.regexp_replace(url, r"^https?://[^/]+", "")


def listing_pages(cat: DataFrame) -> DataFrame:
    """One listing page per LISTING_PAGE_SIZE items: a table of <tr data-entity-id> rows,
    one malformed row, and a pagination link (start, type=1)."""
    codes = F.create_map(*[x for t, c in TYPE_CODES for x in (F.lit(t), F.lit(c))])
    code = F.concat(F.coalesce(F.try_element_at(codes, F.try_element_at("test_type", F.lit(1))), F.lit("")),
                    F.when(F.col("item_id") % 13 == 0, F.lit("X")).otherwise(F.lit("")))
    tr = F.concat(
        F.lit('<tr data-entity-id="'), F.col("item_id").cast("string"), F.lit('"><td class="title"><a href="'),
        _path(F.col("url")), F.lit('">'), F.col("name"), F.lit("</a></td><td>"),
        F.when(F.col("remote_support") == "Yes", F.lit(IMG)).otherwise(F.lit("")), F.lit("</td><td>"),
        F.when(F.col("adaptive_support") == "Yes", F.lit(IMG)).otherwise(F.lit("")),
        F.lit('</td><td><span class="keys">'), code, F.lit("</span></td></tr>"))
    rows = cat.select(F.floor(F.col("item_id") / LISTING_PAGE_SIZE).alias("page_no"), "item_id", tr.alias("tr"))
    g = rows.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("item_id", "tr"))).alias("_rows"))
    start = (F.col("page_no") * LISTING_PAGE_SIZE).cast("string")
    html = F.concat(
        F.lit("<html><body><table><tr><th>Individual Test Solutions</th><th>Remote Testing</th>"
              "<th>Adaptive/IRT</th><th>Test Type</th></tr>"),
        F.array_join(F.transform("_rows", lambda r: r["tr"]), ""),
        F.lit('<tr data-entity-id="broken-'), F.col("page_no").cast("string"), F.lit('"><td>no cells</td></tr>'),
        F.lit('</table><div class="pagination"><a href="/products/product-catalog/?start='), start,
        F.lit('&amp;type=1">'), (F.col("page_no") + 1).cast("string"), F.lit("</a></div></body></html>"))
    return g.select("page_no", F.concat(F.lit(HOST + "/products/product-catalog/?start="), start,
                                        F.lit("&type=1")).alias("url"), html.alias("html"))


def detail_pages(cat: DataFrame) -> DataFrame:
    """One detail page per item: title, optional meta description, <h1>, paragraphs with
    duration, support and category wording."""
    k = F.col("item_id")
    meta = F.when(k % 3 != 0, F.concat(F.lit('<meta name="description" content="'),
                                       F.coalesce(F.col("description"), F.lit("")), F.lit(' &amp; more">')))\
        .otherwise(F.lit(""))
    dur = (F.when(F.col("duration").isNull(), F.lit("Untimed."))
           .when(F.col("duration") > 45, F.lit("Takes about 1 hour."))
           .otherwise(F.concat(F.lit("Approximate time "), F.col("duration").cast("string"), F.lit(" minutes."))))
    support = F.concat(F.when(F.col("remote_support") == "Yes", F.lit(" Take it online.")).otherwise(F.lit("")),
                       F.when(F.col("adaptive_support") == "Yes", F.lit(" Adaptive scoring.")).otherwise(F.lit("")))
    cat_text = (F.when(k % 4 == 0, F.lit(" Knowledge & Skills"))
                .when(k % 4 == 1, F.lit(" An aptitude check."))
                .when(k % 4 == 2, F.lit(" A personality profile."))
                .otherwise(F.lit("")))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("name"), F.lit(" | Shop</title>"), meta,
        F.lit('<script>var s="</p>";</script></head><body><main><h1>'), F.col("name"), F.lit("</h1><p>Short.</p><p>"),
        F.lit("This item description explains in detail what the "), F.col("name"),
        F.lit(" measures and who should take it.</p><p>"), dur, support, cat_text,
        F.lit("</p></main><!-- footer 5 minutes --></body></html>"))
    return cat.select("item_id", "url", html.alias("html"))


def scoped_listing_pages(cat: DataFrame) -> DataFrame:
    """Listing pages with several tables: one of packaged solutions, and inside a layout table one of single items, whose rows
    hold a table of their own. Flags are images, spans or check marks, codes stand in elements or as words."""
    k = F.col("item_id")
    yes = F.when(k % 4 == 0, F.lit(IMG)).when(k % 4 < 3, F.lit('<span class="c">yes</span>')).otherwise(F.lit("&nbsp;✓"))
    mark = lambda c: F.when(F.col(c) == "Yes", yes).otherwise(F.lit(""))
    codes = F.create_map(*[x for t, c in TYPE_CODES for x in (F.lit(t), F.lit(c))])
    letters = F.split(F.coalesce(F.try_element_at(codes, F.try_element_at("test_type", F.lit(1))), F.lit("")), "")
    shown = F.when(k % 2 == 0, F.concat(F.lit("<span>"), F.array_join(letters, "</span> <span>"), F.lit("</span>"))).otherwise(
        F.array_join(letters, " "))
    tr = lambda inner: F.concat(
        F.lit('<tr data-entity-id="'), k.cast("string"), F.lit('"><td><a href="'), _path(F.col("url")), F.lit('">'), F.col("name"),
        F.lit("</a>" + inner + "</td><td>"), mark("remote_support"), F.lit("</td><td>"), mark("adaptive_support"),
        F.lit("</td><td>"), shown, F.lit("</td></tr>"))
    nested = '<table><tr><th>Languages</th></tr><tr data-entity-id="lang"><td><a href="/l/view/x">en</a></td><td></td><td></td><td>A</td></tr></table>'
    rows = cat.select(F.floor(k / LISTING_PAGE_SIZE).alias("page_no"), "item_id", tr(nested).alias("tr"), tr("").alias("plain"))
    g = rows.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("item_id", "tr", "plain"))).alias("_rows"))
    html = F.concat(
        F.lit("<html><body><table><tr><th>Pre-packaged Job Solutions</th></tr>"), F.array_join(F.transform("_rows", lambda r: r["plain"]), ""),
        F.lit("</table><table><tr><td>layout<table><tr><th>Individual Test Solutions</th><th>Remote</th></tr>"),
        F.array_join(F.transform("_rows", lambda r: r["tr"]), ""), F.lit("</table></td></tr></table></body></html>"))
    return g.select("page_no", html.alias("html"))


def labelled_detail_texts(cat: DataFrame) -> DataFrame:
    """(item_id, text): how detail pages label durations, support and categories."""
    k, n = F.col("item_id"), F.coalesce(F.col("duration"), F.lit(7)).cast("string")
    length = (F.when(k % 6 == 0, F.concat(F.lit("Duration: "), n)).when(k % 6 == 1, F.concat(F.lit("Time "), n, F.lit(" to finish")))
              .when(k % 6 == 2, F.concat(F.lit("Assessment Length:  "), n)).when(k % 6 == 3, F.concat(n, F.lit(" mins in all")))
              .when(k % 6 == 4, F.concat(F.lit("Time: 99, or "), n, F.lit(" Minutes"))).otherwise(F.lit("as long as it takes")))
    support = (F.when(k % 5 == 0, F.lit("Taken online.")).when(k % 5 == 1, F.lit("Onlineshop, remotely run, adaptively.")).when(
        k % 5 == 2, F.lit("PROCTORED; an IRT test")).when(k % 5 == 3, F.lit("(Computer Adaptive)")).otherwise(F.lit("on paper")))
    words = F.concat(F.lit("About "), F.when(k % 7 == 0, "numerical reasoning").when(k % 7 == 1, "software and feedback").when(
        k % 7 == 2, "an in-tray exercise").when(k % 7 == 3, "simulated talks").when(k % 7 == 4, "sjt and opq").when(
        k % 7 == 5, "competence, verbal").otherwise("something else"))
    return cat.select("item_id", F.concat_ws(". ", F.lit("<b>"), length, support, words).alias("text"))


def sitemap_docs(cat: DataFrame) -> DataFrame:
    """One sitemap per listing page (its items' URLs as <loc> entries, plus one off-catalogue URL)."""
    rows = cat.select(F.floor(F.col("item_id") / LISTING_PAGE_SIZE).alias("page_no"), "item_id", "url")
    g = rows.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("item_id", "url"))).alias("_u"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset>'),
                   F.array_join(F.transform("_u", lambda x: F.concat(F.lit("<url><loc> "), x["url"],
                                                                     F.lit(" </loc></url>"))), ""),
                   F.lit("<url><loc>" + HOST + "/about/</loc></url></urlset>"))
    return g.select("page_no", xml.alias("xml"))


def robots_docs(pages_df: DataFrame) -> DataFrame:
    """One robots.txt per page origin."""
    origin = F.regexp_extract(F.col("url"), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return pages_df.select(origin.alias("origin")).distinct().select(
        "origin", F.concat(F.lit("User-agent: *\nDisallow: /tmp/\nSitemap: "), F.col("origin"),
                           F.lit("/sitemap.xml\nsitemap:  "), F.col("origin"), F.lit("/sitemap-2.xml \n"))
        .alias("robots"))


def json_docs(cat: DataFrame) -> DataFrame:
    """One JSON payload per item with URLs at several depths and one URL-valued key."""
    payload = F.to_json(F.struct(
        F.col("item_id").alias("id"), F.col("name").alias("title"),
        F.struct(F.col("url").alias("self"), F.col("alternate_urls").alias("alternates")).alias("links"),
        F.array(F.struct(F.lit("related").alias("rel"), F.col("url").alias("href"))).alias("items"),
        F.create_map(F.concat(F.col("url"), F.lit("#key")), F.lit(1)).alias("by_url")))
    bad = F.when(F.col("item_id") % 17 == 0, F.concat(payload, F.lit("}"))).otherwise(payload)
    return cat.select("item_id", bad.alias("json"))
