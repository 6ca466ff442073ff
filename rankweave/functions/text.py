"""Page and document text as column expressions.

HTML is handled with regular expressions that Java and RE2 read the same
way: scripts, styles and comments are removed before any tag is read (pages
contain "</p>" inside script strings), text is the concatenation of text
nodes with tags removed, and a fixed set of named entities is decoded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query_text import contains_any, lit_array
from .urls import VIEW_MARKER, WS_CLASS, after_last, py_strip

# Decoded entities (ampersand last, so "&amp;lt;" stays "&lt;").
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
LINE_BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# Category codes and names, in code order, and the keyword
# rules used when no category name occurs in a page.
CATEGORY_CODES = (
    ("A", "Ability & Aptitude"),
    ("B", "Biodata & Situational Judgement"),
    ("C", "Competencies"),
    ("D", "Development & 360"),
    ("E", "Assessment Exercises"),
    ("K", "Knowledge & Skills"),
    ("P", "Personality & Behavior"),
    ("S", "Simulations"),
)
CATEGORY_KEYWORD_RULES = (
    (("ability", "aptitude", "cognitive"), "Ability & Aptitude"),
    (("personality", "behavior", "behaviour", "trait"), "Personality & Behavior"),
    (("knowledge", "skill", "technical", "programming"), "Knowledge & Skills"),
    (("competency", "competence"), "Competencies"),
)
UNKNOWN_CATEGORY = "Unknown"

# The keyword table of all eight categories, for detail pages (without a match there is no category).
CATEGORY_TABLE = (
    (("ability", "aptitude", "cognitive", "reasoning", "numerical", "verbal"), "Ability & Aptitude"),
    (("knowledge", "skills", "technical", "programming", "software"), "Knowledge & Skills"),
    (("personality", "behavior", "behavioural", "opq"), "Personality & Behavior"),
    (("situational", "judgement", "biodata", "sjt"), "Biodata & Situational Judgement"),
    (("simulation", "simulated", "interactive"), "Simulations"),
    (("exercise", "assessment center", "in-tray"), "Assessment Exercises"),
    (("development", "360", "feedback", "leadership"), "Development & 360"),
    (("competenc", "competency"), "Competencies"),
)

# Words that mark remote and adaptive support; in detail pages they are whole words.
REMOTE_WORDS = ("remote", "online", "virtual", "web-based")
ADAPTIVE_WORDS = ("adaptive", "tailored", "personalized", "dynamic")
DETAIL_REMOTE_WORDS = ("remote", "online", "proctored")
DETAIL_ADAPTIVE_WORDS = ("adaptive", "irt", "computer adaptive")

# Duration patterns and the minutes of their unit, the first that hits counts. Pages: minutes, then
# hours; detail pages: minutes, then labels, in two forms.
PAGE_DURATIONS = ((r"(?i)([0-9]+)\s*(?:mins?|minutes?)", 1), (r"(?i)([0-9]+)\s*(?:hour|hr)s?", 60))
TIME_DURATIONS = ((r"(?i)([0-9]+)\s*minutes?", 1), (r"(?i)Duration[:\s]*([0-9]+)", 1), (r"(?i)Time[:\s]*([0-9]+)", 1),
                  (r"(?i)([0-9]+)\s*mins?", 1))
LENGTH_DURATIONS = ((r"(?i)([0-9]+)\s*minutes?", 1), (r"(?i)Duration[:\s]*([0-9]+)", 1),
                    (r"(?i)Assessment Length[:\s]*([0-9]+)", 1), (r"(?i)([0-9]+)\s*mins?", 1))


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def drop_invisible(html: Column) -> Column:
    """Remove script and style elements and comments."""
    html = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    html = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def inner_text(fragment: Column) -> Column:
    """Text of an HTML fragment, stripped."""
    return py_strip(decode_entities(strip_tags(fragment)))


def page_text(html: Column) -> Column:
    """All visible text of a page (text nodes concatenated)."""
    return decode_entities(strip_tags(drop_invisible(html)))


def first_element_text(html: Column, tag: str) -> Column:
    """Stripped text of the first <tag> element, null when there is none."""
    body = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    has = F.regexp_extract(html, rf"(?is)(<{tag}(?:\s[^>]*)?>)", 1) != ""
    return F.when(has, inner_text(body))


def extract_name(html: Column, site: str | None = None, fallback_on_empty: bool = True) -> Column:
    """First <h1> text; else the <title> with a " | <site>..." suffix removed."""
    clean = drop_invisible(html)
    h1 = first_element_text(clean, "h1")
    title = first_element_text(clean, "title")
    suffix = rf"\s*\|\s*{site}.*" if site else r"\s*\|.*"
    title = F.regexp_replace(title, suffix, "")
    use_h1 = h1.isNotNull() & (h1 != "") if fallback_on_empty else h1.isNotNull()
    return F.when(use_h1, h1).otherwise(F.coalesce(title, F.lit("")))


def meta_description(html: Column) -> Column:
    a = F.regexp_extract(html, r"""(?is)<meta\s[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, r"""(?is)<meta\s[^>]*content\s*=\s*["']([^"']*)["'][^>]*name\s*=\s*["']description["']""", 1)
    m = py_strip(decode_entities(F.when(a != "", a).otherwise(b)))
    return F.when(m != "", m)


def paragraph_texts(html: Column) -> Column:
    """Stripped texts of the <p> elements, in document order."""
    return F.transform(F.regexp_extract_all(drop_invisible(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1),
                       inner_text)


def extract_description(html: Column, max_len: int | None = 512, min_paragraph: int = 50) -> Column:
    """Meta description; else the first paragraph longer than ``min_paragraph``; truncated."""
    first_long = F.try_element_at(F.filter(paragraph_texts(html), lambda p: F.length(p) > min_paragraph),
                                  F.lit(1))
    d = F.coalesce(meta_description(html), first_long, F.lit(""))
    return F.substring(d, 1, max_len) if max_len else d


def extract_duration(text: Column, patterns=PAGE_DURATIONS) -> Column:
    """Minutes by the first of the patterns that occurs; null without any."""
    out = None
    for pattern, unit in patterns:
        found = F.regexp_extract(text, pattern, 1)
        minutes = found.try_cast("bigint") * unit
        out = F.when(found != "", minutes) if out is None else out.when(found != "", minutes)
    return out


def has_word(text: Column, words) -> Column:
    """Whether one of these words occurs with no letter, digit or underscore beside it, in any case."""
    either = "|".join(re.escape(w) for w in words)
    return F.regexp_like(text, F.lit(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{either})(?:[^\p{{L}}\p{{N}}_]|$)"))


def extract_flags(text: Column, remote_words=REMOTE_WORDS, adaptive_words=ADAPTIVE_WORDS, whole_words: bool = False,
                  remote_default: str = "No"):
    """('Yes'/'No' remote, 'Yes'/'No' adaptive) from word lists.

    Words are found anywhere in the text, or only as ``whole_words``; ``remote_default`` is the flag of a text without one.
    """
    if whole_words:
        some = lambda words: has_word(text, words)
    else:
        some = lambda words: contains_any(F.lower(text), words)
    return (F.when(some(remote_words), "Yes").otherwise(remote_default), F.when(some(adaptive_words), "Yes").otherwise("No"))


def classify_tags(text: Column, categories=CATEGORY_CODES, rules=CATEGORY_KEYWORD_RULES,
                  unknown: str | None = UNKNOWN_CATEGORY) -> Column:
    """Category names found in the text; else keyword rules; else ['Unknown']."""
    low = F.lower(text)
    names = F.filter(lit_array([n for _, n in categories]), lambda n: F.instr(low, F.lower(n)) > 0)
    by_rule = F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(cat)) for words, cat in rules]))
    fallback = lit_array([unknown]) if unknown else F.array().cast("array<string>")
    return (F.when(F.size(names) > 0, names).when(F.size(by_rule) > 0, by_rule).otherwise(fallback))


def decode_tag_codes(codes: Column, mode: str = "char", categories=CATEGORY_CODES) -> Column:
    """Category letters -> names, per character or per whitespace token; unknown dropped."""
    m = F.create_map(*[x for code, name in categories for x in (F.lit(code), F.lit(name))])
    parts = (F.split(codes, "") if mode == "char"
             else F.filter(F.split(py_strip(codes), f"{WS_CLASS}+"), lambda t: t != ""))
    return F.filter(F.transform(parts, lambda c: F.try_element_at(m, c)), lambda x: x.isNotNull())


def html_to_text(html: Column) -> Column:
    """Visible text; lines stripped, split on double spaces, non-empty chunks joined by one space."""
    text = page_text(html)
    lines = F.transform(F.split(text, LINE_BREAKS), py_strip)
    chunks = F.transform(F.flatten(F.transform(lines, lambda line: F.split(line, "  "))), py_strip)
    return F.array_join(F.filter(chunks, lambda c: c != ""), " ")


# The original boilerplate patterns (company-page footers).
REFERENCE_BOILERPLATE = (
    r"About Us.*?is an equal opportunity employer\.?",
    r"#CareersAt\w+.*",
    r"Get In Touch.*",
    r"What \w+ Can Offer You.*",
)


def strip_boilerplate(text: Column, patterns=()) -> Column:
    """Remove every pattern (dot-all, case-insensitive), in order, then strip."""
    for p in patterns:
        text = F.regexp_replace(text, "(?isu)" + p, "")
    return py_strip(text)


def doc_text_v1(name: Column, description: Column, tags: Column, remote: Column, adaptive: Column,
                duration: Column) -> Column:
    """E1: '. '-joined item text (name, description, categories, flags, duration)."""
    return F.concat_ws(
        ". ", F.coalesce(name, F.lit("")),
        F.when(F.coalesce(description, F.lit("")) != "", description),
        F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0,
               F.concat(F.lit("Test types: "), F.array_join(tags, ", "))),
        F.when(remote == "Yes", F.lit("Supports remote testing")),
        F.when(adaptive == "Yes", F.lit("Adaptive/IRT assessment")),
        F.when(F.coalesce(duration, F.lit(0)) != 0,
               F.concat(F.lit("Duration: "), duration.cast("string"), F.lit(" minutes"))))


def doc_text_v2(name: Column, description: Column, url: Column, duration: Column, tags: Column,
                remote: Column, adaptive: Column, marker: str = VIEW_MARKER) -> Column:
    """E2: ': '-joined item text (name, description, readable slug, minutes, categories, flags)."""
    slug = F.regexp_replace(after_last(url, marker), r"^/+|/+\z", "")
    readable = F.translate(slug, "-_", "  ")
    return F.concat_ws(
        ": ",
        F.when(F.coalesce(name, F.lit("")) != "", name),
        F.when(F.coalesce(description, F.lit("")) != "", description),
        F.when(F.instr(F.coalesce(url, F.lit("")), marker) > 0, readable),
        F.when(F.coalesce(duration, F.lit(0)) != 0, F.concat(duration.cast("string"), F.lit(" minutes"))),
        F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.array_join(tags, ", ")),
        F.when(remote == "Yes", F.lit("remote testing supported")),
        F.when(adaptive == "Yes", F.lit("adaptive IRT assessment")))
