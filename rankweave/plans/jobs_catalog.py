"""Registered jobs for sources/sinks (A), page extraction (B), URL curation (C),
document text and vectors (E1, E2, E4, E5) and text durations (D10, D11)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query_text as qt
from ..functions import text as T
from ..functions import urls as U
from ..functions.vectors import l2_norm, l2_normalize
from ..operators import curate as C
from ..operators import output as O
from ..operators import pages as P
from ..operators.knn import vector_quality
from ..operators.relevance import counts_for, each_with_each, judged_items, judged_urls
from ..operators.understand import resolve_url_queries
from ..session import scratch_path
from ..sources import adaptors as A
from ..sources import files as FS
from .jobs import Ctx, big

# Fixed values of the driver-table jobs: the boilerplate removed from documents
# and the markers used on the generic web pages.
DOC_BOILERPLATE = (r"(Released|Licensed) under [^\n]*", r"This work is licensed[^\n]*",
                   r"All rights reserved\.?")
PAGE_LINK_MARKER = "/"
SITE = A.HOST
# fixed values: the least last page that the original lists, and the least end of its grid
LAST_START, GRID_STOP = 372, 600


def _scratch(c: Ctx, name: str) -> str:
    return scratch_path(c.spark, f"{name}-{uuid.uuid4().hex}")


def _cat_items(c: Ctx) -> DataFrame:
    return c.cat.drop("vec", "label")


def _parsed_listing(c: Ctx) -> DataFrame:
    return P.parse_catalog_rows(A.listing_pages(c.cat), site=SITE)


def _detail(c: Ctx) -> DataFrame:
    d = A.detail_pages(c.cat)
    text = T.page_text(F.col("html"))
    remote, adaptive = T.extract_flags(text)
    return d.select("item_id", "url",
                    T.extract_name(F.col("html"), site="Shop").alias("name"),
                    T.extract_description(F.col("html")).alias("description"),
                    T.extract_duration(text).alias("duration"),
                    remote.alias("remote_support"), adaptive.alias("adaptive_support"),
                    T.classify_tags(text).alias("test_type"))


# ---------------------------------------------------------------- A: sources and sinks

def a1_read_judgments(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "judgments-csv")
    rel = A.relevance(spark, sf, c.cat, c.qry, also=("query",))
    # the file lists every judgment as a row, packed; a query brings its text, so that judgments aren't joined
    each_with_each(rel.queries, rel.members).where(counts_for(F.col("member"))).select(
        F.col("query").alias("Query"), F.col("url").alias("Assessment_url")) \
        .write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return FS.read_judgments(spark, path)


def a2_read_queries(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "queries-csv")
    c.qry.select(F.col("query").alias("Query")).write.option("header", True).option("escape", '"').csv(path)
    return FS.read_queries(spark, path, dedupe="ordered").select("Query")


def a2_read_queries_all(spark, sf):
    """Every row ('none'), and how many texts are different ('unique')."""
    c = Ctx(spark, sf)
    path = _scratch(c, "queries-csv")
    c.qry.select(F.col("query").alias("Query")).unionByName(c.qry.select(F.upper("query").alias("Query"))).unionByName(
        c.qry.select(F.col("query").alias("Query"))).write.option("header", True).option("escape", '"').csv(path)
    each = FS.read_queries(spark, path, dedupe="none").groupBy("Query").agg(F.count(F.lit(1)).alias("n_rows"))
    return FS.read_queries(spark, path, dedupe="unique").select("Query").join(each, "Query")


def a3_read_catalog(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "catalog-json")
    _cat_items(c).drop("item_id").write.json(path)
    return FS.read_catalog(spark, path, multiline=False).drop("entity_id")


def a3_json_arrays(spark, sf):
    """The array form: each file holds one JSON array of items."""
    c = Ctx(spark, sf)
    path = _scratch(c, "catalog-arrays")
    item = F.struct(*[F.col(x) for x in _cat_items(c).columns if x != "item_id"])
    groups = _cat_items(c).groupBy(F.floor(F.col("item_id") / A.LISTING_PAGE_SIZE).alias("page")).agg(
        F.to_json(F.collect_list(item)).alias("value"))
    groups.write.partitionBy("page").text(path)
    return FS.read_catalog(spark, path).drop("entity_id", "page")


def a4_write_json(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "catalog-json-out")
    FS.write_catalog(_cat_items(c).withColumn("entity_id", F.col("item_id").cast("string")), path, fmt="json")
    return FS.read_catalog(spark, path, multiline=False).drop("entity_id")


def a4_write_catalog(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "catalog-parquet")
    FS.write_catalog(_cat_items(c).withColumn("entity_id", F.col("item_id").cast("string")), path)
    return spark.read.parquet(path)


def a5_write_predictions(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "predictions-csv")
    FS.write_predictions(O.batch_predictions(c.ranked(), c.qry), path)
    return spark.read.schema("Query string, Assessment_url string").option("header", True) \
        .option("escape", '"').option("multiLine", True).csv(path)


def a6_rewrite_with_backup(spark, sf):
    c = Ctx(spark, sf)
    root = _scratch(c, "catalog-versions")
    FS.write_versioned(_cat_items(c).select("item_id", "url", "alternate_urls"), root)
    FS.write_versioned(C.add_alternates(FS.read_current(spark, root)), root)
    prev = FS.read_current(spark, root, version=1).select("item_id", F.col("alternate_urls").alias("previous_alternates"))
    return FS.read_current(spark, root).join(prev, "item_id")


def a7_materialize_vectors(spark, sf):
    c = Ctx(spark, sf)
    path = _scratch(c, "vectors")
    FS.materialize(lambda: c.cat.select("item_id", "vec"), spark, path)            # built and written
    again = FS.materialize(lambda: c.cat.select("item_id", "vec"), spark, path)   # loaded, not rebuilt
    return again.select("item_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


def a8_incremental_catalog(spark, sf):
    c = Ctx(spark, sf)
    return FS.incremental_catalog(_parsed_listing(c), _cat_items(c)).select("url", "name")


def a9_read_pages(spark, sf):
    df = FS.read_pages(spark, f"{sf}/pages.parquet")
    return df.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- B: pages

def b1_extract_links(spark, sf):
    return P.extract_links(Ctx(spark, sf).t("pages"), marker=PAGE_LINK_MARKER)


def b2_extract_sitemap(spark, sf):
    return P.extract_sitemap(A.sitemap_docs(Ctx(spark, sf).cat))


def b2_robots_sitemaps(spark, sf):
    return P.sitemaps_from_robots(A.robots_docs(Ctx(spark, sf).t("pages")))


def b3_extract_json_urls(spark, sf):
    return P.extract_json_urls(A.json_docs(Ctx(spark, sf).cat))


def b4_parse_catalog_rows(spark, sf):
    return _parsed_listing(Ctx(spark, sf))


def b4_table_scope(spark, sf):
    """Rows of the tables headed by single items, of several tables and tables inside tables."""
    return P.parse_catalog_rows(A.scoped_listing_pages(Ctx(spark, sf).cat), site=SITE, header="Individual Test Solutions",
                                flag_rule="span_text", code_mode="element")


def b4_check_marks(spark, sf):
    """All rows below the header cell whose link is an item's, with check marks as flags."""
    return P.parse_catalog_rows(A.scoped_listing_pages(Ctx(spark, sf).cat), site=SITE, header="Individual Test Solutions", header_in="cell",
                                flag_rule="mark", code_mode="token", rows="body", marker=U.VIEW_MARKER).drop("entity_id")


def b5_paginate(spark, sf):
    c = Ctx(spark, sf)
    links = P.extract_links(A.listing_pages(c.cat), marker="type=1", site=SITE)
    return P.paginate(links, SITE + "/products/product-catalog/")


def b5_paginate_floor(spark, sf):
    c = Ctx(spark, sf)
    links = P.extract_links(A.listing_pages(c.cat), marker="type=1", site=SITE)
    return P.paginate(links, SITE + "/products/product-catalog/", min_last_start=LAST_START)


def b5_pagination_grid(spark, sf):
    """The grid goes as far as the listing pages do, and to GRID_STOP at least; of its URLs those that exist."""
    bases = [SITE + "/products/product-catalog/", SITE + "/solutions/products/product-catalog/"]
    known = A.listing_pages(Ctx(spark, sf).cat).select("url")
    stop = max(GRID_STOP, P.last_start(known) + 1)
    return P.pagination_grid(bases, stop=stop, step=12, spark=spark).join(known, "url", "left_semi").select(
        "base", "start", big("type"), "url")


def b6_extract_name(spark, sf):
    p = Ctx(spark, sf).t("pages")
    return p.select("page_id", T.extract_name(F.col("html")).alias("name"))


def b7_extract_description(spark, sf):
    p = Ctx(spark, sf).t("pages")
    return p.select("page_id", T.extract_description(F.col("html")).alias("description"))


def b7_detail_description(spark, sf):
    return _detail(Ctx(spark, sf)).select("item_id", "description")


def b8_extract_duration(spark, sf):
    return _detail(Ctx(spark, sf)).select("item_id", "duration")


def b9_extract_flags(spark, sf):
    return _detail(Ctx(spark, sf)).select("item_id", "remote_support", "adaptive_support")


def b10_classify_tags(spark, sf):
    return _detail(Ctx(spark, sf)).select("item_id", "test_type")


def _labelled(c: Ctx) -> DataFrame:
    """Detail texts of the catalogue and every document."""
    docs = c.t("documents").select((-F.col("doc_id") - 1).alias("item_id"), "text")
    return A.labelled_detail_texts(c.cat).unionByName(docs)


def b8_duration_labels(spark, sf):
    c = F.col("text")
    return _labelled(Ctx(spark, sf)).select("item_id", T.extract_duration(c, T.TIME_DURATIONS).alias("by_time"),
                                            T.extract_duration(c, T.LENGTH_DURATIONS).alias("by_length"))


def b9_word_flags(spark, sf):
    words = (T.DETAIL_REMOTE_WORDS, T.DETAIL_ADAPTIVE_WORDS, True)
    remote, adaptive = T.extract_flags(F.col("text"), *words)
    assumed, _ = T.extract_flags(F.col("text"), *words, remote_default="Yes")
    return _labelled(Ctx(spark, sf)).select("item_id", remote.alias("remote_support"), adaptive.alias("adaptive_support"),
                                            assumed.alias("remote_assumed"))


def b10_category_table(spark, sf):
    tags = T.classify_tags(F.col("text"), rules=T.CATEGORY_TABLE, unknown=None)
    return _labelled(Ctx(spark, sf)).select("item_id", tags.alias("test_type"))


def b10_page_tags(spark, sf):
    p = Ctx(spark, sf).t("pages")
    text = T.page_text(F.col("html"))
    remote, adaptive = T.extract_flags(text)
    return p.select("page_id", T.classify_tags(text).alias("test_type"), remote.alias("remote_support"),
                    adaptive.alias("adaptive_support"), T.extract_duration(text).alias("duration"))


def b11_decode_tag_codes(spark, sf):
    c = Ctx(spark, sf)
    codes = F.create_map(*[x for t, k in A.TYPE_CODES for x in (F.lit(t), F.lit(k))])
    code = F.concat(F.coalesce(F.try_element_at(codes, F.try_element_at("test_type", F.lit(1))), F.lit("")),
                    F.when(F.col("item_id") % 13 == 0, F.lit("X")).otherwise(F.lit("")))
    spaced = F.array_join(F.split(code, ""), " ")
    return c.cat.select("item_id", T.decode_tag_codes(code, "char").alias("by_char"),
                        T.decode_tag_codes(spaced, "token").alias("by_token"))


def b12_html_to_text(spark, sf):
    p = Ctx(spark, sf).t("pages")
    return p.select("page_id", T.html_to_text(F.col("html")).alias("text"))


def b13_strip_boilerplate(spark, sf):
    d = Ctx(spark, sf).t("documents")
    return d.select("doc_id", T.strip_boilerplate(F.col("text"), DOC_BOILERPLATE).alias("text"))


def b14_fix_mojibake(spark, sf):
    d = Ctx(spark, sf).t("documents")
    return d.select("doc_id", O.fix_mojibake(F.col("text")).alias("text"))


def b15_candidate_urls(spark, sf):
    c = Ctx(spark, sf)
    slugs = c.cat.select(U.url_to_slug(F.col("url")).alias("slug"))
    known = c.cat.select(F.explode(F.concat(F.array("url"), "alternate_urls")).alias("url"))
    return P.candidate_urls(slugs, known, [SITE + U.SHORT_PREFIX, SITE + U.LONG_PREFIX], ["/", "", "-new/"])


# ---------------------------------------------------------------- C: URLs and curation

def _all_urls(c: Ctx) -> DataFrame:
    return (c.t("pages").select(F.col("url"))
            .unionByName(c.cat.select("url"))
            .unionByName(c.cat.select(F.explode("alternate_urls").alias("url")))
            .unionByName(c.judged_urls()).distinct())


def c1_url_to_slug(spark, sf):
    c = Ctx(spark, sf)
    return _all_urls(c).select("url", U.url_to_slug(F.col("url")).alias("slug"),
                               U.url_to_slug(F.col("url"), "/en/").alias("slug_en"))


def c2_alternate_url(spark, sf):
    return _all_urls(Ctx(spark, sf)).select("url", U.alternate_url(F.col("url")).alias("alternate"))


def c3_url_for_comparison(spark, sf):
    return _all_urls(Ctx(spark, sf)).select("url", U.url_for_comparison(F.col("url")).alias("cmp"))


def c4_url_variants(spark, sf):
    c = Ctx(spark, sf)
    return c.cat.select("item_id", U.url_variants(F.col("url"), F.col("alternate_urls")).alias("variants"))


def c5_urls_match(spark, sf):
    """Which item each judged URL of a query means; distinct URLs are matched, then each judgment is listed."""
    c = Ctx(spark, sf)
    rel = c.relevance()
    j = judged_urls(rel).select(F.col("Assessment_url").alias("url"), F.explode(U.url_variants(F.col("Assessment_url"))).alias("slug"))
    i = c.cat.select("item_id", F.explode(U.url_variants(F.col("url"), F.col("alternate_urls"))).alias("slug"))
    return judged_items(rel, j.join(i, "slug").select("url", "item_id"))


def c6_add_alternates(spark, sf):
    return C.add_alternates(_cat_items(Ctx(spark, sf))).select("item_id", "alternate_urls")


def c7_drop_packaged(spark, sf):
    c = Ctx(spark, sf)
    links = P.extract_links(c.t("pages"), marker=PAGE_LINK_MARKER)
    return C.drop_packaged(links.unionByName(_all_urls(c))).distinct()


def _sources(c: Ctx) -> dict:
    return {"links": P.extract_links(c.t("pages"), marker=PAGE_LINK_MARKER),
            "sitemap": P.extract_sitemap(A.sitemap_docs(c.cat)),
            "listing": _parsed_listing(c).select("url"),
            "judged": judged_urls(c.relevance()).select(F.col("Assessment_url").alias("url"), F.col("n_queries").alias("n_rows"))}


def c8_union_discovery(spark, sf):
    _, counts = C.union_discovery(_sources(Ctx(spark, sf)))
    return counts


def c8_discovered_urls(spark, sf):
    urls, _ = C.union_discovery(_sources(Ctx(spark, sf)))
    return urls


def c9_dedupe_keep_first(spark, sf):
    c = Ctx(spark, sf)
    both = _cat_items(c).select("url", "name", F.lit(0).alias("seq")).unionByName(
        _parsed_listing(c).select("url", F.upper("name").alias("name"), F.lit(1).alias("seq")))
    return C.dedupe_by_url(both, "seq", "first").select("url", "name")


def c9_dedupe_keep_last(spark, sf):
    c = Ctx(spark, sf)
    both = _cat_items(c).select("url", "name", F.lit(0).alias("seq")).unionByName(
        _parsed_listing(c).select("url", F.upper("name").alias("name"), F.lit(1).alias("seq")))
    return C.dedupe_by_url(both, "seq", "last").select("url", "name")


def c10_merge_detail(spark, sf):
    c = Ctx(spark, sf)
    base = _parsed_listing(c).withColumn("description", F.lit(None).cast("string")) \
        .withColumn("duration", F.lit(None).cast("bigint"))
    return C.merge_detail(base, _detail(c).drop("item_id"))


def _fetched_pages(c: Ctx) -> DataFrame:
    """Stand-in fetched pages for judged URLs outside the catalogue."""
    return c.t("pages").select(F.concat(F.lit(SITE + U.SHORT_PREFIX + "page-"), F.col("page_id").cast("string"),
                                        F.lit("/")).alias("url"), "html")


def c10_override_detail(spark, sf):
    """The detail overrides where it has a value: an empty description and an unknown category are none."""
    c = Ctx(spark, sf)
    d = _detail(c).withColumns({"description": F.nullif(F.col("description"), F.lit("")),
                                "test_type": F.when(F.col("test_type") != F.array(F.lit(T.UNKNOWN_CATEGORY)), F.col("test_type"))})
    return C.override_detail(_parsed_listing(c).withColumns({"description": F.lit(None).cast("string"),
                             "duration": F.lit(None).cast("bigint")}), d.drop("item_id", "remote_support", "adaptive_support"))


def c11_add_missing(spark, sf):
    c = Ctx(spark, sf)
    judged = c.judged_urls().unionByName(_fetched_pages(c).select("url")).withColumnRenamed("url", "Assessment_url")
    return C.add_missing(_cat_items(c), judged, _fetched_pages(c))


def c12_coverage(spark, sf):
    c = Ctx(spark, sf)
    return C.coverage(c.judged_urls(), _cat_items(c), url="url")


def c12_missing_slugs(spark, sf):
    c = Ctx(spark, sf)
    judged = c.judged_urls().unionByName(_fetched_pages(c).select("url")).withColumnRenamed("url", "Assessment_url")
    return C.missing_slugs(judged, _cat_items(c))


def c13_lookup_slugs(spark, sf):
    c = Ctx(spark, sf)
    terms = [n for n, _ in c.lex.concepts] + ["missing-term"]
    return C.lookup_slugs(_cat_items(c), terms).withColumn("ord", F.col("ord").cast("bigint"))


def c13_lookup_judged(spark, sf):
    """Every judged slug, its first half and a term that isn't there, looked up in all items' URLs."""
    c = Ctx(spark, sf)
    slugs = c.judged_urls().select(U.url_to_slug(F.col("url")).alias("term"))
    halves = slugs.select(F.expr("substring(term, 1, length(term) div 2)").alias("term"))
    return C.lookup_terms(_cat_items(c), slugs.unionByName(halves).unionByName(spark.createDataFrame([("missing-term",)], "term string")))


def c13_items_with_term(spark, sf):
    c = Ctx(spark, sf)
    return C.items_with_term(_cat_items(c), [r for r, _ in c.lex.roles])


def c14_completeness_gate(spark, sf):
    return C.completeness_gate(_cat_items(Ctx(spark, sf)))


# ---------------------------------------------------------------- D10, D11

def d10_max_duration(spark, sf):
    conv = Ctx(spark, sf).t("conversations").where(F.col("role") == "user")
    return conv.select("conv_id", "turn", qt.max_duration(F.col("text")).alias("max_duration"))


def d11_resolve_url_queries(spark, sf):
    """User turns and page URLs as queries: some padded, some unknown, some empty; every fifth page
    a second time under its URL."""
    c = Ctx(spark, sf)
    pages = c.t("pages")
    copies = pages.where("page_id % 5 = 2").select((-F.col("page_id") - 1).alias("page_id"), "url",
                                                   F.concat(F.lit("<p>older</p>"), "html").alias("html"))
    text_q = c.t("conversations").where(F.col("role") == "user") \
        .select(F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    k = F.col("page_id") % 10
    url_q = pages.select(F.concat_ws(":", F.lit("p"), "page_id").alias("query_id"),
                         F.when(k == 0, F.concat("url", F.lit("?missing"))).when(k == 1, F.concat(F.lit(" \t"), "url", F.lit("\n ")))
                          .when(k == 2, F.lit("  ")).when(k == 3, F.concat(F.lit(" about "), "url"))
                          .otherwise(F.col("url")).alias("query"))
    pages = pages.select("page_id", "url", "html").unionByName(copies)
    resolved, rejects = resolve_url_queries(text_q.unionByName(url_q), pages,
                                            boilerplate=T.REFERENCE_BOILERPLATE)
    return resolved.select("query_id", "query").unionByName(
        rejects.select("query_id", F.lit(None).cast("string").alias("query")))


# ---------------------------------------------------------------- E1, E2, E4, E5

def e1_doc_text_v1(spark, sf):
    c = Ctx(spark, sf)
    return c.cat.select("item_id", T.doc_text_v1(F.col("name"), F.col("description"), F.col("test_type"),
                                                 F.col("remote_support"), F.col("adaptive_support"),
                                                 F.col("duration")).alias("text"))


def e2_doc_text_v2(spark, sf):
    c = Ctx(spark, sf)
    return c.cat.select("item_id", T.doc_text_v2(F.col("name"), F.col("description"), F.col("url"),
                                                 F.col("duration"), F.col("test_type"), F.col("remote_support"),
                                                 F.col("adaptive_support")).alias("text"))


def e4_vector_quality(spark, sf):
    return vector_quality(Ctx(spark, sf).t("embeddings"), "embedding")


def e5_l2_normalize(spark, sf):
    e = Ctx(spark, sf).t("embeddings")
    n = l2_normalize(F.col("embedding"))
    return e.select("vec_id", F.round(l2_norm(F.col("embedding")), 6).alias("norm"),
                    F.transform(n, lambda x: F.round(x, 6)).alias("vec"))


JOBS = {
    "A1_read_judgments": a1_read_judgments,
    "A2_read_queries": a2_read_queries,
    "A2_read_queries_all": a2_read_queries_all,
    "A3_read_catalog": a3_read_catalog,
    "A4_write_catalog": a4_write_catalog,
    "A5_write_predictions": a5_write_predictions,
    "A6_rewrite_with_backup": a6_rewrite_with_backup,
    "A7_materialize_vectors": a7_materialize_vectors,
    "A8_incremental_catalog": a8_incremental_catalog,
    "A9_read_pages": a9_read_pages,
    "B1_extract_links": b1_extract_links,
    "B2_extract_sitemap": b2_extract_sitemap,
    "B2_robots_sitemaps": b2_robots_sitemaps,
    "B3_extract_json_urls": b3_extract_json_urls,
    "B4_parse_catalog_rows": b4_parse_catalog_rows,
    "B4_table_scope": b4_table_scope,
    "B4_check_marks": b4_check_marks,
    "B5_paginate": b5_paginate,
    "B6_extract_name": b6_extract_name,
    "B7_extract_description": b7_extract_description,
    "B7_detail_description": b7_detail_description,
    "B8_extract_duration": b8_extract_duration,
    "B8_duration_labels": b8_duration_labels,
    "B9_extract_flags": b9_extract_flags,
    "B9_word_flags": b9_word_flags,
    "B10_classify_tags": b10_classify_tags,
    "B10_page_tags": b10_page_tags,
    "B10_category_table": b10_category_table,
    "B11_decode_tag_codes": b11_decode_tag_codes,
    "B12_html_to_text": b12_html_to_text,
    "B13_strip_boilerplate": b13_strip_boilerplate,
    "B14_fix_mojibake": b14_fix_mojibake,
    "B15_candidate_urls": b15_candidate_urls,
    "C1_url_to_slug": c1_url_to_slug,
    "C2_alternate_url": c2_alternate_url,
    "C3_url_for_comparison": c3_url_for_comparison,
    "C4_url_variants": c4_url_variants,
    "C5_urls_match": c5_urls_match,
    "C6_add_alternates": c6_add_alternates,
    "C7_drop_packaged": c7_drop_packaged,
    "C8_union_discovery": c8_union_discovery,
    "C8_discovered_urls": c8_discovered_urls,
    "C9_dedupe_keep_first": c9_dedupe_keep_first,
    "C9_dedupe_keep_last": c9_dedupe_keep_last,
    "C10_merge_detail": c10_merge_detail,
    "C10_override_detail": c10_override_detail,
    "C11_add_missing": c11_add_missing,
    "C12_coverage": c12_coverage,
    "C12_missing_slugs": c12_missing_slugs,
    "C13_lookup_slugs": c13_lookup_slugs,
    "C13_lookup_judged": c13_lookup_judged,
    "C13_items_with_term": c13_items_with_term,
    "C14_completeness_gate": c14_completeness_gate,
    "D10_max_duration": d10_max_duration,
    "D11_resolve_url_queries": d11_resolve_url_queries,
    "E1_doc_text_v1": e1_doc_text_v1,
    "E2_doc_text_v2": e2_doc_text_v2,
    "E4_vector_quality": e4_vector_quality,
    "E5_l2_normalize": e5_l2_normalize,
    "A3_json_arrays": a3_json_arrays,
    "A4_write_json": a4_write_json,
    "B5_paginate_floor": b5_paginate_floor,
    "B5_pagination_grid": b5_pagination_grid,
}
