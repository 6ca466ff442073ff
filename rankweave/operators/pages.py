"""Page-table extraction (B1-B5, B15): per-page parsing re-expressed as table jobs.

Each operator maps a table of documents (HTML, sitemap XML, robots text,
JSON) to a table of rows with regular-expression column functions and
``explode``; set semantics are a ``distinct``. Nothing is fetched: the page
tables are the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.jsonval import json_is_valid
from ..functions.urls import VIEW_MARKER, py_strip

HREF_RE = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
JSON_STRING_RE = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
TR_RE = r"(?is)<tr\s[^>]*data-entity-id[^>]*>.*?</tr>"
TD_RE = r"(?is)<td(?:\s[^>]*)?>(.*?)</td>"


def origin(url: Column) -> Column:
    """scheme://host of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def absolutize(href: Column, site: Column, catalog_url: Column) -> Column:
    return (F.when(F.lower(href).startswith("http"), href)
            .when(href.startswith("/"), F.concat(site, href))
            .otherwise(F.concat(catalog_url, href)))


def extract_links(pages: DataFrame, marker: str = VIEW_MARKER, site: str | None = None,
                  catalog_url: str | None = None) -> DataFrame:
    """B1: distinct absolute URLs of every <a href> containing ``marker``.

    Absolute hrefs are kept; "/x" is prefixed with the site (default: the
    page's own origin); anything else with the catalogue URL (default: the
    page URL's directory).
    """
    site_c = F.lit(site) if site else origin(F.col("url"))
    cat_c = F.lit(catalog_url) if catalog_url else F.regexp_extract(F.col("url"), r"^(.*/)", 1)
    hrefs = pages.select(site_c.alias("_site"), cat_c.alias("_cat"),
                         F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF_RE), 1)).alias("_href"))
    hrefs = hrefs.withColumn("_href", T.decode_entities(F.col("_href")))
    return (hrefs.where(F.instr(F.col("_href"), marker) > 0)
            .select(absolutize(F.col("_href"), F.col("_site"), F.col("_cat")).alias("url"))
            .distinct())


def extract_sitemap(docs: DataFrame, marker: str = VIEW_MARKER, col: str = "xml") -> DataFrame:
    """B2: distinct <loc> values containing ``marker`` from sitemap documents."""
    locs = docs.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(r"(?is)<loc>(.*?)</loc>"), 1)).alias("u"))
    return locs.select(py_strip(T.decode_entities(F.col("u"))).alias("url")) \
        .where(F.instr(F.col("url"), marker) > 0).distinct()


def sitemaps_from_robots(docs: DataFrame, col: str = "robots") -> DataFrame:
    """B2: sitemap addresses named in robots.txt texts ("Sitemap: <url>" lines)."""
    lines = docs.select(F.explode(F.split(F.col(col), "\n")).alias("line"))
    return (lines.where(F.lower(py_strip(F.col("line"))).startswith("sitemap:"))
            .select(py_strip(F.regexp_extract(F.col("line"), r"^[^:]*:(.*)$", 1)).alias("url"))
            .distinct())


def extract_json_urls(docs: DataFrame, marker: str = VIEW_MARKER, col: str = "json") -> DataFrame:
    """Every JSON string *value* (not key) containing ``marker``, at any depth.

    Invalid JSON yields nothing. String literals are found with one regular
    expression; a literal followed by ':' is a key.
    """
    valid = docs.where(json_is_valid(F.col(col)))
    strs = F.regexp_extract_all(F.col(col), F.lit(JSON_STRING_RE), 1)
    colons = F.regexp_extract_all(F.col(col), F.lit(JSON_STRING_RE), 2)
    values = F.filter(F.arrays_zip(strs.alias("s"), colons.alias("c")), lambda z: z["c"] == "")
    out = valid.select(F.explode(F.transform(values, lambda z: z["s"])).alias("s"))
    unescaped = F.replace(F.replace(F.col("s"), F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit('"'))
    return out.select(unescaped.alias("url")).where(F.instr(F.col("url"), marker) > 0).distinct()


def table_texts(html):
    """The markup of each table of a page without that of tables inside it, in the order of their ends.

    The page is cut at table tags. One fold over the pieces keeps the tables that are open, innermost last; a piece
    belongs to the innermost one. Pieces outside of tables, and tables that aren't closed, belong to none.
    """
    pieces = F.split(html, r"(?is)(?=<table[\s>])|(?<=</table>)")
    text = F.lit("").cast("string")
    none = F.filter(F.array(text), lambda x: F.lit(False))

    def step(acc, piece):
        opens = F.regexp_like(piece, F.lit(r"(?is)^<table[\s>]"))
        stack = F.when(opens, F.concat(acc["open"], F.array(piece))).when(
            F.size(acc["open"]) > 0, F.concat(F.slice(acc["open"], 1, F.size(acc["open"]) - 1),
                                              F.array(F.concat(F.element_at(acc["open"], -1), piece)))).otherwise(acc["open"])
        ends = F.regexp_like(piece, F.lit(r"(?is)</table>$")) & (F.size(stack) > 0)
        return F.struct(F.when(ends, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack).alias("open"),
                        F.when(ends, F.concat(acc["done"], F.slice(stack, -1, 1))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(pieces, F.struct(none.alias("open"), none.alias("done")), step)["done"]


def _flag(cell, rule: str):
    low = F.lower(cell)
    yes = F.instr(low, "<img") > 0
    if rule == "span_text":    # or the first span holds text
        yes = yes | (T.inner_text(F.regexp_extract(cell, r"(?is)<span(?:\s[^>]*)?>(.*?)</span>", 1)) != "")
    elif rule == "mark":       # or there is a span or a check mark
        yes = yes | F.regexp_like(low, F.lit(r"<span[\s>]")) | (F.instr(cell, "✓") > 0)
    elif rule != "image":
        raise ValueError(f"unknown flag rule {rule!r}")
    return F.when(yes, "Yes").otherwise("No")


def _codes(cell, mode: str):
    if mode != "element":
        return T.decode_tag_codes(T.inner_text(cell), mode)
    # one code in each span or div; without such elements, the cell's words
    parts = F.transform(F.regexp_extract_all(cell, F.lit(r"(?is)<(?:span|div)(?:\s[^>]*)?>([^<]*)"), F.lit(1)), T.inner_text)
    names = F.flatten(F.transform(parts, lambda p: F.when(F.instr(p, " ") == 0, T.decode_tag_codes(p, "token")).otherwise(
        F.array().cast("array<string>"))))
    return F.when(F.size(parts) > 0, names).otherwise(T.decode_tag_codes(T.inner_text(cell), "token"))


def parse_catalog_rows(pages: DataFrame, site: str, col: str = "html", marker: str | None = None,
                       code_mode: str = "char", header: str | None = None, header_in: str = "row", flag_rule: str = "image",
                       rows: str = "entity") -> DataFrame:
    """Catalogue rows from listing pages.

    Every <tr data-entity-id> with at least 4 <td>: cell 1 holds the name and
    link, cell 2 an image when remote testing is supported, cell 3 an image
    when adaptive, cell 4 the category letters. Rows without a link (or, when
    ``marker`` is given, whose link lacks it) are skipped.

    ``header``: only rows of tables whose first row (``header_in='cell'``: its first cell) contains this text; a
    row belongs to its innermost table. ``flag_rule``: 'image', 'span_text' (or a span with text), 'mark' (or any span or a check
    mark). ``code_mode``: 'char', 'token', 'element'. ``rows``: 'entity', or 'body' for all but the first of a table.
    """
    scoped = header is not None or rows == "body"
    if scoped:
        first_row = F.regexp_extract("table", r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>", 1)
        head = first_row if header_in == "row" else F.regexp_extract(first_row, r"(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>", 1)
        source = pages.select(F.explode(table_texts(T.drop_invisible(F.col(col)))).alias("table"))
        if header is not None:
            source = source.where(F.instr(T.inner_text(head), header) > 0)
        found = F.regexp_extract_all(F.col("table"), F.lit(TR_RE if rows == "entity" else r"(?is)<tr(?:\s[^>]*)?>.*?</tr>"), F.lit(0))
        trs = source.select(F.explode(found if rows == "entity" else F.slice(found, 2, 1 << 30)).alias("tr"))
    else:
        trs = pages.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(TR_RE), 0)).alias("tr"))
    cells = F.regexp_extract_all(F.col("tr"), F.lit(TD_RE), 1)
    r = trs.select(F.regexp_extract("tr", r"""data-entity-id\s*=\s*["']([^"']*)["']""", 1).alias("entity_id"),
                   cells.alias("cells")).where(F.size("cells") >= 4)
    cell = lambda k: F.try_element_at(F.col("cells"), F.lit(k))
    href = T.decode_entities(F.regexp_extract(cell(1), r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1))
    link_text = F.regexp_extract(cell(1), r"(?is)<a(?:\s[^>]*)?>(.*?)</a>", 1)
    has_link = F.regexp_extract(cell(1), r"(?is)(<a\s)", 1) != ""
    out = r.select(
        "entity_id",
        absolutize(href, F.lit(site), F.lit(site + "/")).alias("url"),
        T.inner_text(link_text).alias("name"),
        _flag(cell(2), flag_rule).alias("remote_support"),
        _flag(cell(3), flag_rule).alias("adaptive_support"),
        _codes(cell(4), code_mode).alias("test_type"),
        has_link.alias("_has_link"), href.alias("_href"))
    keep = F.col("_has_link") if marker is None else F.col("_has_link") & (F.instr(F.col("_href"), marker) > 0)
    return out.where(keep).drop("_has_link", "_href")


def last_start(links: DataFrame, type_value: str = "1") -> int:
    """The largest ``start`` parameter among links of the given type, 0 without any."""
    starts = links.where(F.col("url").rlike(rf"[?&]type={type_value}(&|$)")) \
        .select(F.regexp_extract("url", r"[?&]start=([0-9]+)", 1).alias("s")) \
        .where(F.col("s") != "").select(F.col("s").try_cast("bigint").alias("s"))
    return starts.agg(F.max("s").alias("s")).first()["s"] or 0


def paginate(links: DataFrame, catalog_url: str, step: int = 12, type_value: str = "1",
             min_last_start: int = 0) -> DataFrame:
    """Listing-page URLs start=0..max step ``step``, where max is the largest
    ``start`` parameter among links of the given type (at least ``min_last_start``)."""
    last = max(last_start(links, type_value), min_last_start)
    # a range in partitions: one odd link mustn't become one long array in one row
    return links.sparkSession.range(0, last + 1, step).select(F.col("id").alias("start")) \
        .select("start", F.concat(F.lit(catalog_url), F.lit("?start="), F.col("start").cast("string"),
                                  F.lit(f"&type={type_value}")).alias("url"))


def pagination_grid(bases, stop: int = 500, step: int = 12, types=(1, 2), spark=None) -> DataFrame:
    """The fixed grid base x start x type of listing URLs (generated with explode, no join)."""
    df = spark.range(0, stop, step).select(F.col("id").alias("start"))
    df = df.select("start", F.explode(F.array(*[F.lit(t) for t in types])).alias("type"))
    df = df.select("start", "type", F.explode(F.array(*[F.lit(b) for b in bases])).alias("base"))
    return df.select("base", "start", "type",
                     F.concat("base", F.lit("?start="), F.col("start").cast("string"), F.lit("&type="),
                              F.col("type").cast("string")).alias("url"))


def candidate_urls(slugs: DataFrame, known: DataFrame, bases, suffixes, slug: str = "slug") -> DataFrame:
    """Base x slug x suffix URLs that exist in the known-URL table (semi join)."""
    cand = slugs.select(F.col(slug).alias("slug"),
                        F.explode(F.array(*[F.lit(b) for b in bases])).alias("base"))
    cand = cand.select("slug", "base", F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("suffix"))
    cand = cand.select("slug", "base", "suffix", F.concat("base", "slug", "suffix").alias("url")).distinct()
    return cand.join(known.select("url").distinct(), "url", "left_semi")
