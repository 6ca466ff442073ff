"""Query understanding as column expressions.

Lexicon terms are inlined as literal arrays and matched with higher-order
functions, so understanding a table of queries is a single narrow projection.
Substring semantics follow the original (``term in text``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon
from .urls import WS_CLASS

WORD_RE = r"[\p{L}\p{N}_]+"

# Query duration patterns in the order they are tried, and the
# two literal spellings joined before matching.
DURATION_PATTERNS = (
    r"([0-9]+)\s*minutes?",
    r"([0-9]+)\s*mins?",
    r"([0-9]+)\s*hours?",
    r"([0-9]+)\s*hrs?",
    r"duration[:\s]*([0-9]+)",
    r"max[:\s]*([0-9]+)",
    r"about\s*([0-9]+)",
)
DURATION_WORDS = ("min", "min", "hour", "hr", "duration", "max", "about")   # stand in whatever the patterns match
HOUR_PATTERN_INDEXES = (2, 3)
JOINED_SPELLINGS = (("Java Script", "JavaScript"), ("java script", "javascript"))

# page/text duration patterns (minutes, then hours).
MAX_DURATION_PATTERNS = (
    r"([0-9]+)\s*(?:mins?|minutes?)",
    r"([0-9]+)\s*(?:hour|hr)",
)
HOURS_AND_MINUTES_PATTERN = r"([0-9]+)\s*(?:hour|hr)s?\s*([0-9]+)\s*(?:mins?|minutes?)"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


MAX_COMPARED = 1_000


def deciding(terms) -> list[str]:
    """The terms that decide whether any of them is in a text: those without another one inside."""
    terms = list(dict.fromkeys(terms))
    return terms if len(terms) > MAX_COMPARED else [t for t in terms if not any(u != t and u in t for u in terms)]


def contains_any(text: Column, terms) -> Column:
    """True when any literal term is a substring of ``text``."""
    if not terms:
        return F.lit(False)
    return F.exists(lit_array(deciding(terms)), lambda t: F.contains(text, t))


def clean_query(q: Column) -> Column:
    """Collapse whitespace, strip, join two spellings."""
    # a blank that stands alone stays as it is, so that in most texts little is replaced; then all white space is blanks
    out = F.trim(F.regexp_replace(q, f" {WS_CLASS}+|(?! ){WS_CLASS}+", " "))
    for a, b in JOINED_SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _first_int(text: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit.try_cast("bigint"))


def query_duration(q_lower: Column, unit_scope: str = "query") -> Column:
    """First duration pattern that matches, in minutes.

    ``unit_scope='query'`` multiplies by 60 when "hour" or "hr" occurs anywhere
    in the query (the original behaviour); ``'match'`` only when the matched
    pattern is an hour pattern.
    """
    hour_anywhere = F.contains(q_lower, F.lit("hour")) | F.contains(q_lower, F.lit("hr"))
    branches = []
    for i, (pat, word) in enumerate(zip(DURATION_PATTERNS, DURATION_WORDS, strict=True)):
        val = F.when(F.contains(q_lower, F.lit(word)), _first_int(q_lower, pat))
        if unit_scope == "query":
            val = F.when(hour_anywhere, val * 60).otherwise(val)
        elif i in HOUR_PATTERN_INDEXES:
            val = val * 60
        branches.append(val)
    return F.coalesce(*branches)


def max_duration(text: Column, scale_hours: bool = False) -> Column:
    """Per pattern the first match; keep the minimum.

    The hour-only pattern is unscaled by default, as in the original;
    ``scale_hours=True`` converts it to minutes.
    """
    low = F.lower(text)
    minutes = _first_int(low, MAX_DURATION_PATTERNS[0])
    hours = _first_int(low, MAX_DURATION_PATTERNS[1])
    if scale_hours:
        hours = hours * 60
    hm = F.when(F.regexp_extract(low, HOURS_AND_MINUTES_PATTERN, 1) != "",
                F.regexp_extract(low, HOURS_AND_MINUTES_PATTERN, 1).try_cast("bigint") * 60
                + F.regexp_extract(low, HOURS_AND_MINUTES_PATTERN, 2).try_cast("bigint"))
    return F.array_min(F.array_compact(F.array(minutes, hours, hm)))


def _concepts_lit(lex: Lexicon) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("concept"), lit_array(v).alias("variants"), lit_array(deciding(v)).alias("triggers"))
                     for c, v in lex.concepts])


def query_skills(q_lower: Column, lex: Lexicon) -> Column:
    """D3: all variants of every concept with a variant in the query, lexicon order, distinct."""
    if not lex.concepts:
        return F.array().cast("array<string>")
    hit = F.filter(_concepts_lit(lex),
                   lambda c: F.exists(c["triggers"], lambda v: F.contains(q_lower, v)))
    return F.array_distinct(F.flatten(F.transform(hit, lambda c: c["variants"])))


def query_roles(q_lower: Column, lex: Lexicon) -> Column:
    """Roles with a keyword in the query, lexicon order."""
    if not lex.roles:
        return F.array().cast("array<string>")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), lit_array(deciding(k)).alias("keywords"))
                      for r, k in lex.roles])
    hit = F.filter(roles, lambda r: F.exists(r["keywords"], lambda k: F.contains(q_lower, k)))
    return F.array_distinct(F.transform(hit, lambda r: r["role"]))


def _rule_terms(q_lower: Column, rules) -> Column:
    if not rules:
        return F.array().cast("array<string>")
    arr = F.array(*[F.struct(lit_array(deciding(t)).alias("triggers"), lit_array(v).alias("values"))
                    for t, v in rules])
    hit = F.filter(arr, lambda r: F.exists(r["triggers"], lambda t: F.contains(q_lower, t)))
    return F.flatten(F.transform(hit, lambda r: r["values"]))


def query_tag_prefs(q_lower: Column, lex: Lexicon) -> Column:
    """Preferred categories; a bag (duplicates kept), rule order."""
    return _rule_terms(q_lower, lex.tag_rules)


def job_terms(q_lower: Column, lex: Lexicon) -> Column:
    return _rule_terms(q_lower, lex.job_rules)


def expand_query(q_clean: Column, skills: Column, roles: Column, jobs: Column) -> Column:
    """Query + first 8 skills, first 5 roles, first 3 job terms not already contained."""
    low = F.lower(q_clean)

    def absent(arr: Column, n: int) -> Column:
        return F.filter(F.slice(arr, 1, n), lambda t: ~F.contains(low, t))

    return F.array_join(F.concat(F.array(q_clean), absent(skills, 8), absent(roles, 5),
                                 absent(jobs, 3)), " ")


def boost_keywords(q_lower: Column, lex: Lexicon) -> Column:
    """Boost terms that are substrings of the query, list order."""
    return F.filter(lit_array(lex.boost_terms), lambda t: F.contains(q_lower, t))


def query_words(q_lower: Column) -> Column:
    """Distinct word tokens (``\\b\\w+\\b``), sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(q_lower, F.lit(WORD_RE), 0)))


def boost_tokens(q_lower: Column, lex: Lexicon) -> Column:
    """Query word tokens that are in the token vocabulary (sorted). Texts without any term aren't cut into words."""
    tokens = F.array_sort(F.array_intersect(query_words(q_lower), lit_array(lex.token_terms)))
    return F.when(~contains_any(q_lower, lex.token_terms), F.array().cast("array<string>")).otherwise(tokens)


def fallback_terms(q_lower: Column, terms) -> Column:
    """Fallback skill or role terms that are substrings of the query."""
    return F.filter(lit_array(terms), lambda t: F.contains(q_lower, t))
