"""Catalogue curation and data quality.

All set logic is joins on normalised keys (URL or slug), semi/anti joins
and grouped counts; substring lookups run against a bounded literal term list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query_text import lit_array
from ..functions.urls import VIEW_MARKER, after_last, alternate_url, py_strip, rstrip_slashes, url_variants

EMPTY = "array<string>"
# URL fragments of packaged (non-individual) catalogue entries.
PACKAGED_MARKERS = ("pre-packaged", "job-solution")
MIN_CATALOGUE_ITEMS = 377


def add_alternates(catalog: DataFrame) -> DataFrame:
    """alternate_urls gets the generated alternate when it differs and is absent."""
    alts = F.coalesce(F.col("alternate_urls"), F.array().cast(EMPTY))
    gen = alternate_url(F.col("url"))
    return catalog.withColumn(
        "alternate_urls",
        F.when((gen != F.col("url")) & ~F.array_contains(alts, gen), F.concat(alts, F.array(gen)))
         .otherwise(alts))


def drop_packaged(df: DataFrame, url: str = "url", markers=PACKAGED_MARKERS) -> DataFrame:
    """Exclude URLs of packaged solutions."""
    low = F.lower(F.col(url))
    keep = F.lit(True)
    for m in markers:
        keep = keep & (F.instr(low, m) == 0)
    return df.where(keep)


def union_discovery(sources: dict) -> tuple[DataFrame, DataFrame]:
    """Set union of URL sources. Returns (distinct urls with first source, per-source counts).

    A source that lists a URL many times may come as distinct URLs with their ``n_rows``.
    """
    union = None
    for i, (name, df) in enumerate(sources.items()):
        times = F.col("n_rows") if "n_rows" in df.columns else F.lit(1)
        part = df.select(F.col("url"), F.lit(i).alias("_o"), times.cast("long").alias("_times"))
        union = part if union is None else union.unionByName(part)
    names = list(sources)
    # one pass over the sources: how often each URL stands in each of them
    per = union.groupBy("url").agg(F.min("_o").alias("_first"), *[F.sum(F.when(F.col("_o") == i, F.col("_times")).otherwise(0)).alias(f"_n{i}") for i in range(len(names))])
    urls = per.select("url", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_first") + 1).alias("source"))
    total = per.agg(F.count(F.lit(1)).alias("_urls"), *[x for i in range(len(names)) for x in (
        F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_r{i}"), F.count_if(F.col(f"_n{i}") > 0).alias(f"_d{i}"))])
    rows = [F.struct(F.lit(n).alias("source"), F.col(f"_r{i}").alias("n_rows"), F.col(f"_d{i}").alias("n_distinct")) for i, n in enumerate(names)]
    every = F.struct(F.lit("ALL").alias("source"), sum((F.col(f"_r{i}") for i in range(1, len(names))), F.col("_r0")).alias("n_rows"),
                     F.col("_urls").alias("n_distinct"))
    counts = total.select(F.inline(F.array(*rows, every)))
    return urls, counts.where((F.col("source") == "ALL") | (F.col("n_rows") > 0))


def dedupe_by_url(df: DataFrame, seq: str, keep: str = "first", url: str = "url") -> DataFrame:
    """One row per URL, the first (or last) by ``seq``.

    A grouped min_by/max_by: it combines map-side before the shuffle, so a URL
    that repeats across a large share of the rows never lands whole in one task.
    """
    others = [c for c in df.columns if c != url]
    pick = F.min_by if keep == "first" else F.max_by
    out = df.groupBy(url).agg(pick(F.struct(*others), F.col(seq)).alias("_row"))
    return out.select(url, "_row.*")


def merge_detail(base: DataFrame, detail: DataFrame) -> DataFrame:
    """Base rows left-joined with detail rows on URL.

    name and categories prefer the base (falsy -> detail), description and
    duration come from the detail, flags from the base with defaults. A base
    row without detail is kept as it is.
    """
    d = detail.select("url", *[F.col(c).alias("d_" + c) for c in
                               ("name", "description", "duration", "test_type")], F.lit(True).alias("_has"))
    j = base.join(d, "url", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    tags = F.coalesce(F.col("test_type"), F.array().cast(EMPTY))
    return j.select(
        "url",
        F.when(has, F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(F.col("d_name")))
         .otherwise(F.col("name")).alias("name"),
        F.when(has, F.col("d_description")).otherwise(F.col("description")).alias("description"),
        F.when(has, F.col("d_duration")).otherwise(F.col("duration")).alias("duration"),
        F.when(has, F.coalesce(F.col("remote_support"), F.lit("Yes"))).otherwise(F.col("remote_support"))
         .alias("remote_support"),
        F.when(has, F.coalesce(F.col("adaptive_support"), F.lit("No"))).otherwise(F.col("adaptive_support"))
         .alias("adaptive_support"),
        F.when(has, F.when(F.size(tags) > 0, tags).otherwise(F.coalesce(F.col("d_test_type"),
                                                                         F.array().cast(EMPTY))))
         .otherwise(F.col("test_type")).alias("test_type"))


def override_detail(base: DataFrame, detail: DataFrame, columns=("name", "description", "duration", "remote_support",
                                                                "adaptive_support", "test_type")) -> DataFrame:
    """C10, where the detail overrides: every column that a base row's detail row has a value for gets that value."""
    held = [c for c in columns if c in detail.columns]
    j = base.join(detail.select("url", *[F.col(c).alias("d_" + c) for c in held]), "url", "left")
    return j.select(*[F.coalesce("d_" + c, c).alias(c) if c in held else F.col(c) for c in base.columns])


def raw_slug(url, marker: str = VIEW_MARKER):
    """Case-sensitive slug: text after the last marker without trailing '/' (null without marker)."""
    return F.when(F.instr(url, marker) > 0, rstrip_slashes(after_last(url, marker)))


def add_missing(catalog: DataFrame, judged: DataFrame, pages: DataFrame, url: str = "Assessment_url",
                marker: str = VIEW_MARKER) -> DataFrame:
    """C11: judged URLs whose (case-sensitive) slug is absent from the catalogue,
    described from their fetched page (name, description, categories), with
    defaults remote='Yes', adaptive='No' and one alternate URL."""
    have = catalog.select(raw_slug(F.col("url"), marker).alias("slug")).where(F.col("slug").isNotNull()).distinct()
    j = judged.select(py_strip(F.col(url)).alias("url")).distinct() \
        .withColumn("slug", raw_slug(F.col("url"), marker)).where(F.col("slug").isNotNull())
    missing = j.join(have, "slug", "left_anti")
    p = pages.select("url", "html")
    m = missing.join(p, "url", "left")
    name = T.first_element_text(T.drop_invisible(F.col("html")), "h1")
    main_ps = T.paragraph_texts(F.regexp_extract(F.col("html"), r"(?is)<main(?:\s[^>]*)?>(.*?)</main>", 1))
    desc = F.coalesce(T.meta_description(F.col("html")),
                      F.try_element_at(F.filter(main_ps, lambda x: F.length(x) > 50), F.lit(1)))
    alt = F.when(F.instr(F.col("url"), "/solutions/products/") > 0,
                 F.replace(F.col("url"), F.lit("/solutions/products/"), F.lit("/products/"))) \
        .otherwise(F.replace(F.col("url"), F.lit("/products/"), F.lit("/solutions/products/")))
    return m.select(
        "url",
        F.coalesce(F.when(name != "", name), F.lit("Unknown")).alias("name"),
        desc.alias("description"),
        F.lit(None).cast("int").alias("duration"),
        F.lit("Yes").alias("remote_support"), F.lit("No").alias("adaptive_support"),
        F.when(F.col("html").isNull(), F.array().cast(EMPTY))
         .otherwise(T.classify_tags(T.page_text(F.col("html")), rules=ADD_MISSING_RULES, unknown=None,
                                    categories=())).alias("test_type"),
        F.array(alt).alias("alternate_urls"))


# Category keyword table used when describing missing items.
ADD_MISSING_RULES = (
    (("ability", "aptitude", "cognitive", "reasoning"), "Ability & Aptitude"),
    (("knowledge", "skills", "technical"), "Knowledge & Skills"),
    (("personality", "behavior", "opq"), "Personality & Behavior"),
    (("situational", "judgement", "biodata"), "Biodata & Situational Judgement"),
    (("simulation", "simulated"), "Simulations"),
    (("exercise", "assessment center"), "Assessment Exercises"),
    (("development", "360", "feedback"), "Development & 360"),
    (("competenc", "competency"), "Competencies"),
)


def coverage(judged: DataFrame, catalog: DataFrame, url: str = "Assessment_url") -> DataFrame:
    """Judged-slug coverage by catalogue variant slugs, and the share of items with alternates."""
    from ..functions.urls import url_to_slug
    js = judged.select(url_to_slug(py_strip(F.col(url))).alias("slug")).distinct()
    cs = catalog.select(F.explode(url_variants(F.col("url"), F.col("alternate_urls"))).alias("slug")).distinct()
    j = js.join(cs.withColumn("_in", F.lit(True)), "slug", "left")
    # three one-row aggregates as (metric, value) rows, folded by one aggregate
    metrics = (j.agg(F.count(F.lit(1)).alias("n_judged_slugs"), F.count_if(F.col("_in").isNotNull()).alias("n_covered"))
               .select(F.inline(F.array(F.struct(F.lit("n_judged_slugs").alias("m"), F.col("n_judged_slugs").alias("v")),
                                        F.struct(F.lit("n_covered").alias("m"), F.col("n_covered").alias("v")))))
               .unionByName(cs.agg(F.lit("n_catalog_slugs").alias("m"), F.count(F.lit(1)).alias("v")))
               .unionByName(catalog.select(F.inline(F.array(
                   F.struct(F.lit("n_items").alias("m"), F.lit(1).cast("bigint").alias("v")),
                   F.struct(F.lit("n_with_alternates").alias("m"),
                            F.when(F.size(F.coalesce("alternate_urls", F.array().cast(EMPTY))) > 0, 1)
                             .otherwise(0).cast("bigint").alias("v")))))))
    names = ("n_judged_slugs", "n_catalog_slugs", "n_covered", "n_items", "n_with_alternates")
    out = metrics.agg(*[F.coalesce(F.sum(F.when(F.col("m") == n, F.col("v"))), F.lit(0)).cast("bigint").alias(n)
                        for n in names])
    return out.select(
        "n_judged_slugs", "n_catalog_slugs", "n_covered",
        (F.col("n_judged_slugs") - F.col("n_covered")).alias("n_missing"),
        F.when(F.col("n_judged_slugs") > 0, F.col("n_covered") / F.col("n_judged_slugs")).otherwise(0.0)
         .alias("coverage"),
        "n_items", "n_with_alternates",
        F.when(F.col("n_items") > 0, F.col("n_with_alternates") / F.col("n_items")).otherwise(0.0)
         .alias("alternates_share"))


def missing_slugs(judged: DataFrame, catalog: DataFrame, url: str = "Assessment_url") -> DataFrame:
    """C12 detail: judged slugs that no catalogue variant covers."""
    from ..functions.urls import url_to_slug
    js = judged.select(url_to_slug(py_strip(F.col(url))).alias("slug")).distinct()
    cs = catalog.select(F.explode(url_variants(F.col("url"), F.col("alternate_urls"))).alias("slug"))
    return js.join(cs, "slug", "left_anti")


def lookup_slugs(catalog: DataFrame, terms) -> DataFrame:
    """For each term of a bounded list: FOUND/MISSING, the number of items whose
    lower-case URL contains it and the first such item (by item id)."""
    hits = catalog.select("item_id", "name",
                          F.explode(F.filter(lit_array(terms), lambda t: F.instr(F.lower(F.col("url")), t) > 0))
                          .alias("term"))
    agg = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_found"),
                                   F.min(F.struct("item_id", "name")).alias("_first"))
    all_terms = catalog.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, ord int")
    return (all_terms.join(agg, "term", "left")
            .select("term", "ord",
                    F.when(F.col("n_found").isNotNull(), "FOUND").otherwise("MISSING").alias("status"),
                    F.coalesce("n_found", F.lit(0)).alias("n_found"),
                    F.col("_first.item_id").alias("first_item_id"), F.col("_first.name").alias("first_name")))


def lookup_terms(catalog: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """C13 for a table of terms, however many: what ``lookup_slugs`` returns, without ``ord``, by posting lists of grams."""
    from .terms import contains_join, distinct_terms
    urls = catalog.select("item_id", F.lower(F.col("url")).alias("text"))
    hits = contains_join(urls, terms, "item_id", term=term).join(catalog.select("item_id", "name"), "item_id")
    agg = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_found"), F.min(F.struct("item_id", "name")).alias("_first"))
    return distinct_terms(terms, term).join(agg, "term", "left").select(
        "term", F.when(F.col("n_found").isNotNull(), "FOUND").otherwise("MISSING").alias("status"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"), F.col("_first.item_id").alias("first_item_id"),
        F.col("_first.name").alias("first_name"))


def items_with_term(catalog: DataFrame, terms) -> DataFrame:
    """Items whose lower-case name contains any of a bounded list of terms."""
    return catalog.select("item_id", "name", "url",
                          F.explode(F.filter(lit_array(terms), lambda t: F.instr(F.lower(F.col("name")), t) > 0))
                          .alias("term"))


def completeness_gate(catalog: DataFrame, min_items: int = MIN_CATALOGUE_ITEMS) -> DataFrame:
    """C14: item count, parsed (non-empty name) vs failed, and whether the count reaches the minimum."""
    named = F.coalesce(py_strip(F.col("name")), F.lit("")) != ""
    return catalog.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(named).alias("n_parsed"),
                       F.count_if(~named).alias("n_failed")) \
        .withColumn("passed", F.col("n_items") >= min_items)
