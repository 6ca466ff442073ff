"""URL normalisation as column expressions (no UDFs).

All functions take and return ``Column`` objects, so they can be used both on
plain columns and inside higher-order-function lambdas (``transform``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The catalogue path marker and the two equivalent catalogue
# path prefixes, and the four percent-escapes that slugs decode.
VIEW_MARKER = "/view/"
LONG_PREFIX = "/solutions/products/product-catalog/view/"
SHORT_PREFIX = "/products/product-catalog/view/"
SOLUTIONS_SEGMENT = "/solutions/products/"
PRODUCTS_SEGMENT = "/products/"
SLUG_ESCAPES = (("%28", "("), ("%29", ")"), ("%20", " "), ("%2d", "-"))

# Python's str.isspace() set, written so that Java regex and RE2 agree.
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def py_strip(col: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col, f"^{WS_CLASS}+|{WS_CLASS}+\\z", "")


def rstrip_slashes(col: Column) -> Column:
    return F.regexp_replace(col, r"/+\z", "")


def after_last(col: Column, marker: str) -> Column:
    """Part of ``col`` after the last occurrence of a literal marker."""
    return F.substring_index(col, marker, -1)


def decode_slug_escapes(col: Column) -> Column:
    for escaped, plain in SLUG_ESCAPES:
        col = F.replace(col, F.lit(escaped), F.lit(plain))
    return col


def url_to_slug(url: Column, marker: str = VIEW_MARKER) -> Column:
    """Canonical slug of a URL.

    null/'' -> ''; lower, strip, drop trailing '/'; when the marker occurs,
    keep the part after its last occurrence and decode four escapes;
    otherwise return the normalised URL.
    """
    norm = rstrip_slashes(py_strip(F.lower(url)))
    slug = decode_slug_escapes(rstrip_slashes(after_last(norm, marker)))
    return (F.when(url.isNull() | (url == ""), F.lit(""))
            .when(F.instr(norm, marker) > 0, slug)
            .otherwise(norm))


def alternate_url(url: Column) -> Column:
    """Swap the long and short catalogue prefixes.

    The containment test is case-insensitive; the replacement is
    case-sensitive. The long prefix is tested first.
    """
    low = F.lower(url)
    return (F.when(url.isNull() | (url == ""), url)
            .when(F.instr(low, LONG_PREFIX) > 0,
                  F.replace(url, F.lit(LONG_PREFIX), F.lit(SHORT_PREFIX)))
            .when(F.instr(low, SHORT_PREFIX) > 0,
                  F.replace(url, F.lit(SHORT_PREFIX), F.lit(LONG_PREFIX)))
            .otherwise(url))


def url_for_comparison(url: Column) -> Column:
    """Comparison form of a full URL (path unified, escapes decoded, lower)."""
    out = rstrip_slashes(url)
    out = F.replace(out, F.lit(SOLUTIONS_SEGMENT), F.lit(PRODUCTS_SEGMENT))
    out = decode_slug_escapes(out)
    return F.when(url.isNull() | (url == ""), F.lit("")).otherwise(F.lower(out))


def url_variants(url: Column, alternates: Column | None = None,
                 marker: str = VIEW_MARKER) -> Column:
    """C4: sorted distinct slugs of the URL, its alternates and its generated alternate."""
    alt = alternate_url(url)
    generated = F.when(alt != url, F.array(alt)).otherwise(F.array().cast("array<string>"))
    alts = (F.coalesce(alternates, F.array().cast("array<string>"))
            if alternates is not None else F.array().cast("array<string>"))
    every = F.concat(F.array(url), alts, generated)
    return F.array_sort(F.array_distinct(F.transform(every, lambda u: url_to_slug(u, marker))))


def urls_match(variants_a: Column, variants_b: Column) -> Column:
    """Two URLs match when their variant-slug sets intersect."""
    return F.arrays_overlap(variants_a, variants_b)
