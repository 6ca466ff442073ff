"""Oracle SQL for sources (A), pages (B), URLs and curation (C), D10, D11, E1-E5.

Jobs over the driver's raw pages/documents re-parse the HTML with the same
regular expressions (RE2). Jobs over composed documents (listing pages,
detail pages, sitemaps, JSON payloads) are checked against the ground truth
computed directly from the catalogue view they were composed from.
"""

from __future__ import annotations

from .queries import HYB, KNN
from .sqlparts import (HOST, LONG, SHORT, alt, for_comparison, py_strip, rules_cte, slug, variants,
                       with_base)

SITE = HOST
LINE_BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
HREF_RE = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
CATEGORIES = (("A", "Ability & Aptitude"), ("B", "Biodata & Situational Judgement"), ("C", "Competencies"),
              ("D", "Development & 360"), ("E", "Assessment Exercises"), ("K", "Knowledge & Skills"),
              ("P", "Personality & Behavior"), ("S", "Simulations"))
RULES = ((("ability", "aptitude", "cognitive"), "Ability & Aptitude"),
         (("personality", "behavior", "behaviour", "trait"), "Personality & Behavior"),
         (("knowledge", "skill", "technical", "programming"), "Knowledge & Skills"),
         (("competency", "competence"), "Competencies"))
ADD_MISSING_RULES = (
    (("ability", "aptitude", "cognitive", "reasoning"), "Ability & Aptitude"),
    (("knowledge", "skills", "technical"), "Knowledge & Skills"),
    (("personality", "behavior", "opq"), "Personality & Behavior"),
    (("situational", "judgement", "biodata"), "Biodata & Situational Judgement"),
    (("simulation", "simulated"), "Simulations"),
    (("exercise", "assessment center"), "Assessment Exercises"),
    (("development", "360", "feedback"), "Development & 360"),
    (("competenc", "competency"), "Competencies"))
TYPE_CODES = (("ECONOMY", "AK"), ("LARGE", "P"), ("MEDIUM", "KS"), ("PROMO", "B"), ("SMALL", "CD"),
              ("STANDARD", "E"))
DOC_BOILERPLATE = (r"(Released|Licensed) under [^\n]*", r"This work is licensed[^\n]*", r"All rights reserved\.?")
REFERENCE_BOILERPLATE = (r"About Us.*?is an equal opportunity employer\.?", r"#CareersAt\w+.*", r"Get In Touch.*",
                         r"What \w+ Can Offer You.*")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def decode(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def drop_invisible(h: str) -> str:
    h = f"regexp_replace({h}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    h = f"regexp_replace({h}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    return f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def inner_text(x: str) -> str:
    return py_strip(decode(strip_tags(x)))


def page_text(h: str) -> str:
    return decode(strip_tags(drop_invisible(h)))


def first_text(h: str, tag: str) -> str:
    body = f"regexp_extract({h}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
    has = f"regexp_extract({h}, '(?is)(<{tag}(?:\\s[^>]*)?>)', 1) <> ''"
    return f"(CASE WHEN {has} THEN {inner_text(body)} END)"


def extract_name(h: str, site: str | None = None) -> str:
    clean = drop_invisible(h)
    h1 = first_text(clean, "h1")
    suffix = f"\\s*\\|\\s*{site}.*" if site else "\\s*\\|.*"
    title = f"regexp_replace({first_text(clean, 'title')}, {lit(suffix)}, '', 'g')"
    return f"(CASE WHEN {h1} IS NOT NULL AND {h1} <> '' THEN {h1} ELSE coalesce({title}, '') END)"


def meta_desc(h: str) -> str:
    a = f"""regexp_extract({h}, {lit(r'''(?is)<meta\s[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["']''')}, 1)"""
    b = f"""regexp_extract({h}, {lit(r'''(?is)<meta\s[^>]*content\s*=\s*["']([^"']*)["'][^>]*name\s*=\s*["']description["']''')}, 1)"""
    m = py_strip(decode(f"(CASE WHEN {a} <> '' THEN {a} ELSE {b} END)"))
    return f"(CASE WHEN {m} <> '' THEN {m} END)"


def paragraphs(h: str) -> str:
    ps = f"regexp_extract_all({drop_invisible(h)}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1)"
    return f"list_transform({ps}, lambda pp: {inner_text('pp')})"


def extract_description(h: str) -> str:
    first = f"list_filter({paragraphs(h)}, lambda pq: length(pq) > 50)[1]"
    return f"substring(coalesce({meta_desc(h)}, {first}, ''), 1, 512)"


def extract_duration(t: str) -> str:
    m = f"regexp_extract({t}, '(?i)([0-9]+)\\s*(?:mins?|minutes?)', 1)"
    hh = f"regexp_extract({t}, '(?i)([0-9]+)\\s*(?:hour|hr)s?', 1)"
    return (f"(CASE WHEN {m} <> '' THEN TRY_CAST({m} AS BIGINT) "
            f"WHEN {hh} <> '' THEN TRY_CAST({hh} AS BIGINT) * 60 END)")


def any_in(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {lit(w)})" for w in words) + ")"


def flags(t: str) -> tuple[str, str]:
    low = f"lower({t})"
    r = f"(CASE WHEN {any_in(low, ('remote', 'online', 'virtual', 'web-based'))} THEN 'Yes' ELSE 'No' END)"
    a = f"(CASE WHEN {any_in(low, ('adaptive', 'tailored', 'personalized', 'dynamic'))} THEN 'Yes' ELSE 'No' END)"
    return r, a


# fixed values: the keyword table of all eight categories
_CATEGORY_TABLE = (
    ("Ability & Aptitude", ("ability", "aptitude", "cognitive", "reasoning", "numerical", "verbal")),
    ("Knowledge & Skills", ("knowledge", "skills", "technical", "programming", "software")),
    ("Personality & Behavior", ("personality", "behavior", "behavioural", "opq")),
    ("Biodata & Situational Judgement", ("situational", "judgement", "biodata", "sjt")),
    ("Simulations", ("simulation", "simulated", "interactive")),
    ("Assessment Exercises", ("exercise", "assessment center", "in-tray")),
    ("Development & 360", ("development", "360", "feedback", "leadership")),
    ("Competencies", ("competenc", "competency")),
)
_CATEGORY_TABLE = tuple((words, name) for name, words in _CATEGORY_TABLE)


def classify(t: str, categories=CATEGORIES, rules=RULES, unknown: str | None = "Unknown") -> str:
    low = f"lower({t})"
    names = f"list_filter({lst([n for _, n in categories])}, lambda n: contains({low}, lower(n)))" \
        if categories else "[]::VARCHAR[]"
    by_rule = "list_filter([" + ", ".join(f"CASE WHEN {any_in(low, w)} THEN {lit(c)} END" for w, c in rules) + \
        "], lambda x: x IS NOT NULL)"
    fb = lst([unknown]) if unknown else "[]::VARCHAR[]"
    return f"(CASE WHEN len({names}) > 0 THEN {names} WHEN len({by_rule}) > 0 THEN {by_rule} ELSE {fb} END)"


def code_name(ch: str) -> str:
    return "(CASE " + " ".join(f"WHEN {ch} = {lit(c)} THEN {lit(n)}" for c, n in CATEGORIES) + " END)"


def decode_codes(codes: str) -> str:
    return f"list_filter(list_transform(string_split({codes}, ''), lambda ch: {code_name('ch')}), lambda x: x IS NOT NULL)"


def type_code(tt: str, item: str) -> str:
    m = "(CASE " + " ".join(f"WHEN {tt}[1] = {lit(t)} THEN {lit(c)}" for t, c in TYPE_CODES) + " ELSE '' END)"
    return f"({m} || CASE WHEN {item} % 13 = 0 THEN 'X' ELSE '' END)"


def html_to_text(h: str) -> str:
    t = page_text(h)
    lines = f"list_transform(regexp_split_to_array({t}, {lit(LINE_BREAKS)}), lambda ln: {py_strip('ln')})"
    chunks = f"list_transform(flatten(list_transform({lines}, lambda l2: string_split(l2, '  '))), lambda ck: {py_strip('ck')})"
    return f"array_to_string(list_filter({chunks}, lambda c3: c3 <> ''), ' ')"


def strip_boilerplate(x: str, patterns) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {lit('(?is)' + p)}, '', 'g')"
    return py_strip(x)


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def links_cte(name: str = "links", marker: str = "/") -> str:
    return f"""
{name} AS (
  SELECT DISTINCT CASE WHEN starts_with(lower(href), 'http') THEN href
                       WHEN starts_with(href, '/') THEN site || href ELSE catu || href END AS url
  FROM (SELECT site, catu, {decode('h0')} AS href FROM (
          SELECT {origin('url')} AS site, regexp_extract(url, '^(.*/)', 1) AS catu,
                 unnest(regexp_extract_all(html, {lit(HREF_RE)}, 1)) AS h0 FROM pages))
  WHERE contains(href, {lit(marker)})
)"""


ALL_URLS = """
allu AS (
  SELECT DISTINCT url FROM (
    SELECT url FROM pages UNION ALL SELECT url FROM catx
    UNION ALL SELECT unnest(alternate_urls) FROM catx UNION ALL SELECT "Assessment_url" FROM jdg)
)"""

DETAIL_TRUTH = f"""
detail AS (
  SELECT item_id, url, name,
    substring(CASE WHEN item_id % 3 <> 0 THEN {py_strip("coalesce(description, '') || ' & more'")}
         ELSE 'This item description explains in detail what the ' || name || ' measures and who should take it.'
         END, 1, 512) AS description,
    CAST(CASE WHEN duration IS NULL THEN NULL WHEN duration > 45 THEN 60 ELSE duration END AS BIGINT) AS duration,
    remote_support, adaptive_support,
    CASE item_id % 4 WHEN 0 THEN ['Knowledge & Skills'] WHEN 1 THEN ['Ability & Aptitude']
                     WHEN 2 THEN ['Personality & Behavior'] ELSE ['Unknown'] END AS test_type
  FROM catx
)"""

LISTING_TRUTH = f"""
listing AS (
  SELECT CAST(item_id AS VARCHAR) AS entity_id, url, name, remote_support, adaptive_support,
         {decode_codes(type_code('test_type', 'item_id'))} AS test_type
  FROM catx
)"""

FETCHED = f"""
fetched AS (SELECT '{SITE}{SHORT}page-' || CAST(page_id AS VARCHAR) || '/' AS url, html FROM pages)"""

C6 = ("CASE WHEN {a} <> url AND NOT list_contains(coalesce(alternate_urls, []::VARCHAR[]), {a}) "
      "THEN list_concat(coalesce(alternate_urls, []::VARCHAR[]), [{a}]) "
      "ELSE coalesce(alternate_urls, []::VARCHAR[]) END").format(a=alt("url"))

SQL: dict[str, str] = {}
B = with_base

# ---------------------------------------------------------------- A
SQL["A1_read_judgments"] = B() + \
    f'SELECT DISTINCT {py_strip(chr(34) + "Query" + chr(34))} AS "Query", {slug(py_strip(chr(34) + "Assessment_url" + chr(34)))} AS slug FROM jdg'
SQL["A2_read_queries"] = B() + 'SELECT DISTINCT query AS "Query" FROM qry'
SQL["A2_read_queries_all"] = B() + """SELECT "Query", count(*) AS n_rows FROM (
  SELECT query AS "Query" FROM qry UNION ALL SELECT upper(query) FROM qry UNION ALL SELECT query FROM qry) GROUP BY "Query\""""
SQL["A3_read_catalog"] = B() + \
    "SELECT url, name, description, duration, remote_support, adaptive_support, test_type, alternate_urls FROM catx"
SQL["A3_json_arrays"] = SQL["A3_read_catalog"]
SQL["A4_write_json"] = SQL["A3_read_catalog"]
SQL["A4_write_catalog"] = B() + ("SELECT item_id, url, name, description, duration, remote_support, adaptive_support, "
                                 "test_type, alternate_urls FROM catx")
SQL["A5_write_predictions"] = with_base(KNN, HYB, rules_cte(10)) + \
    'SELECT q.query AS "Query", r.url AS "Assessment_url" FROM ruled r JOIN qry q ON r.query_id = q.query_id'
SQL["A6_rewrite_with_backup"] = B() + \
    f"SELECT item_id, url, {C6} AS alternate_urls, alternate_urls AS previous_alternates FROM catx"
SQL["A7_materialize_vectors"] = B() + "SELECT item_id, list_transform(vec, lambda x: round(x, 6)) AS vec FROM catx"
SQL["A8_incremental_catalog"] = B() + \
    f"SELECT url, name FROM catx WHERE coalesce({py_strip('description')}, '') = ''"
SQL["A9_read_pages"] = B() + "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"

# ---------------------------------------------------------------- B
SQL["B1_extract_links"] = B(links_cte()) + "SELECT url FROM links"
SQL["B2_extract_sitemap"] = B() + "SELECT DISTINCT url FROM catx"
SQL["B2_robots_sitemaps"] = B() + f"""
SELECT DISTINCT o || '/sitemap.xml' AS url FROM (SELECT {origin('url')} AS o FROM pages)
UNION SELECT DISTINCT o || '/sitemap-2.xml' FROM (SELECT {origin('url')} AS o FROM pages)"""
SQL["B3_extract_json_urls"] = B() + """
SELECT DISTINCT url FROM (SELECT url FROM catx WHERE item_id % 17 <> 0
                          UNION ALL SELECT unnest(alternate_urls) FROM catx WHERE item_id % 17 <> 0)"""
SQL["B4_parse_catalog_rows"] = B(LISTING_TRUTH) + "SELECT * FROM listing"
_LETTERS = "list_filter(string_split(CASE test_type[1] " + " ".join(f"WHEN {lit(t)} THEN {lit(c)}" for t, c in TYPE_CODES) + \
    " ELSE '' END, ''), lambda x: x <> '')"
_NAMED = f"list_filter(list_transform({_LETTERS}, lambda ch: {code_name('ch')}), lambda x: x IS NOT NULL)"
SQL["B4_table_scope"] = B() + f"""
SELECT CAST(item_id AS VARCHAR) AS entity_id, url, name,
       CASE WHEN remote_support = 'Yes' AND item_id % 4 <> 3 THEN 'Yes' ELSE 'No' END AS remote_support,
       CASE WHEN adaptive_support = 'Yes' AND item_id % 4 <> 3 THEN 'Yes' ELSE 'No' END AS adaptive_support,
       {_NAMED} AS test_type FROM catx"""
SQL["B4_check_marks"] = B() + f"SELECT url, name, remote_support, adaptive_support, {_NAMED} AS test_type FROM catx"
SQL["B5_paginate"] = B() + f"""
SELECT s AS start, '{SITE}/products/product-catalog/?start=' || CAST(s AS VARCHAR) || '&type=1' AS url
FROM (SELECT unnest(range(0, mx + 1, 12)) AS s FROM (SELECT max(item_id // 12) * 12 AS mx FROM catx))"""
SQL["B5_paginate_floor"] = B() + f"""
SELECT s AS start, '{SITE}/products/product-catalog/?start=' || CAST(s AS VARCHAR) || '&type=1' AS url
FROM (SELECT unnest(range(0, mx + 1, 12)) AS s FROM (SELECT greatest(max(item_id // 12) * 12, 372) AS mx FROM catx))"""
SQL["B5_pagination_grid"] = B() + f"""
SELECT DISTINCT '{SITE}/products/product-catalog/' AS base, item_id // 12 * 12 AS start, 1::BIGINT AS type,
       '{SITE}/products/product-catalog/?start=' || CAST(item_id // 12 * 12 AS VARCHAR) || '&type=1' AS url
FROM catx"""
SQL["B6_extract_name"] = B() + f"SELECT page_id, {extract_name('html')} AS name FROM pages"
SQL["B7_extract_description"] = B() + f"SELECT page_id, {extract_description('html')} AS description FROM pages"
SQL["B7_detail_description"] = B(DETAIL_TRUTH) + "SELECT item_id, description FROM detail"
SQL["B8_extract_duration"] = B(DETAIL_TRUTH) + "SELECT item_id, duration FROM detail"
SQL["B9_extract_flags"] = B(DETAIL_TRUTH) + "SELECT item_id, remote_support, adaptive_support FROM detail"
SQL["B10_classify_tags"] = B(DETAIL_TRUTH) + "SELECT item_id, test_type FROM detail"
_LABELLED = """
labelled AS (
  SELECT item_id, '<b>. ' || CASE item_id % 6
      WHEN 0 THEN 'Duration: ' || n WHEN 1 THEN 'Time ' || n || ' to finish' WHEN 2 THEN 'Assessment Length:  ' || n
      WHEN 3 THEN n || ' mins in all' WHEN 4 THEN 'Time: 99, or ' || n || ' Minutes' ELSE 'as long as it takes' END
    || '. ' || CASE item_id % 5 WHEN 0 THEN 'Taken online.' WHEN 1 THEN 'Onlineshop, remotely run, adaptively.'
      WHEN 2 THEN 'PROCTORED; an IRT test' WHEN 3 THEN '(Computer Adaptive)' ELSE 'on paper' END
    || '. About ' || CASE item_id % 7 WHEN 0 THEN 'numerical reasoning' WHEN 1 THEN 'software and feedback' WHEN 2 THEN 'an in-tray exercise'
      WHEN 3 THEN 'simulated talks' WHEN 4 THEN 'sjt and opq' WHEN 5 THEN 'competence, verbal' ELSE 'something else' END AS text
  FROM (SELECT *, CAST(coalesce(duration, 7) AS VARCHAR) AS n FROM catx)
  UNION ALL SELECT -doc_id - 1, text FROM documents)"""


def first_number(patterns) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_extract(text, {lit(p)}, 1) <> '' THEN TRY_CAST(regexp_extract(text, {lit(p)}, 1) AS BIGINT)"
                               for p in patterns) + " END)"


def whole_word(words) -> str:
    either = "|".join(words)
    return f"regexp_matches(text, {lit(r'(?i)(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(?:' + either + ')(?:[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')})"


_MINUTES, _LENGTH, _MINS = r"(?i)([0-9]+)\s*minutes?", r"(?i)Duration[:\s]*([0-9]+)", r"(?i)([0-9]+)\s*mins?"
SQL["B8_duration_labels"] = B(_LABELLED) + f"""
SELECT item_id, {first_number((_MINUTES, _LENGTH, r"(?i)Time[:\s]*([0-9]+)", _MINS))} AS by_time,
       {first_number((_MINUTES, _LENGTH, r"(?i)Assessment Length[:\s]*([0-9]+)", _MINS))} AS by_length FROM labelled"""
SQL["B9_word_flags"] = B(_LABELLED) + f"""
SELECT item_id, CASE WHEN {whole_word(('remote', 'online', 'proctored'))} THEN 'Yes' ELSE 'No' END AS remote_support,
       CASE WHEN {whole_word(('adaptive', 'irt', 'computer adaptive'))} THEN 'Yes' ELSE 'No' END AS adaptive_support,
       'Yes' AS remote_assumed FROM labelled"""
SQL["B10_category_table"] = B(_LABELLED) + f"SELECT item_id, {classify('text', rules=_CATEGORY_TABLE, unknown=None)} AS test_type FROM labelled"
_PT = page_text("html")
_R, _A = flags("pt")
SQL["B10_page_tags"] = B() + f"""
SELECT page_id, {classify('pt')} AS test_type, {_R} AS remote_support, {_A} AS adaptive_support,
       {extract_duration('pt')} AS duration
FROM (SELECT page_id, {_PT} AS pt FROM pages)"""
SQL["B11_decode_tag_codes"] = B() + f"""
SELECT item_id, {decode_codes(type_code('test_type', 'item_id'))} AS by_char,
       {decode_codes(type_code('test_type', 'item_id'))} AS by_token FROM catx"""
SQL["B12_html_to_text"] = B() + f"SELECT page_id, {html_to_text('html')} AS text FROM pages"
SQL["B13_strip_boilerplate"] = B() + f"SELECT doc_id, {strip_boilerplate('text', DOC_BOILERPLATE)} AS text FROM documents"
SQL["B14_fix_mojibake"] = B() + \
    "SELECT doc_id, replace(replace(replace(text, 'â€¦', '…'), 'â€\"', '—'), 'â€™', '''') AS text FROM documents"
SQL["B15_candidate_urls"] = B() + f"""
SELECT DISTINCT url, slug, base, suffix FROM (
  SELECT base || slug || suffix AS url, slug, base, suffix
  FROM (SELECT {slug('url')} AS slug FROM catx),
       (SELECT unnest(['{SITE}{SHORT}', '{SITE}{LONG}']) AS base),
       (SELECT unnest(['/', '', '-new/']) AS suffix))
WHERE url IN (SELECT url FROM catx UNION ALL SELECT unnest(alternate_urls) FROM catx)"""

# ---------------------------------------------------------------- C
SQL["C1_url_to_slug"] = B(ALL_URLS) + f"SELECT url, {slug('url')} AS slug, {slug('url', '/en/')} AS slug_en FROM allu"
SQL["C2_alternate_url"] = B(ALL_URLS) + f"SELECT url, {alt('url')} AS alternate FROM allu"
SQL["C3_url_for_comparison"] = B(ALL_URLS) + f"SELECT url, {for_comparison('url')} AS cmp FROM allu"
SQL["C4_url_variants"] = B() + f"SELECT item_id, {variants('url', 'alternate_urls')} AS variants FROM catx"
SQL["C5_urls_match"] = B() + f"""
SELECT DISTINCT j.query_id, j."Assessment_url", i.item_id
FROM (SELECT query_id, "Assessment_url", unnest({variants('"Assessment_url"', 'NULL::VARCHAR[]')}) AS slug FROM jdg) j
JOIN (SELECT item_id, unnest({variants('url', 'alternate_urls')}) AS slug FROM catx) i ON j.slug = i.slug"""
SQL["C6_add_alternates"] = B() + f"SELECT item_id, {C6} AS alternate_urls FROM catx"
SQL["C7_drop_packaged"] = B(links_cte(), ALL_URLS) + """
SELECT DISTINCT url FROM (SELECT url FROM links UNION ALL SELECT url FROM allu)
WHERE NOT contains(lower(url), 'pre-packaged') AND NOT contains(lower(url), 'job-solution')"""
SQL["C8_union_discovery"] = B(links_cte()) + """,
src AS (
  SELECT url, 'links' AS source FROM links
  UNION ALL SELECT DISTINCT url, 'sitemap' FROM catx
  UNION ALL SELECT url, 'listing' FROM catx
  UNION ALL SELECT "Assessment_url", 'judged' FROM jdg
)
SELECT source, count(*) AS n_rows, count(DISTINCT url) AS n_distinct FROM src GROUP BY source
UNION ALL SELECT 'ALL', count(*), count(DISTINCT url) FROM src"""
SQL["C8_discovered_urls"] = B(links_cte()) + """,
src AS (
  SELECT url, 'links' AS source, 0 AS o FROM links
  UNION ALL SELECT DISTINCT url, 'sitemap', 1 FROM catx
  UNION ALL SELECT url, 'listing', 2 FROM catx
  UNION ALL SELECT "Assessment_url", 'judged', 3 FROM jdg
)
SELECT url, arg_min(source, o) AS source FROM src GROUP BY url"""
SQL["C9_dedupe_keep_first"] = B() + "SELECT url, name FROM catx"
SQL["C9_dedupe_keep_last"] = B() + "SELECT url, upper(name) AS name FROM catx"
SQL["C10_merge_detail"] = B(LISTING_TRUTH, DETAIL_TRUTH) + """
SELECT l.url, CASE WHEN coalesce(l.name, '') <> '' THEN l.name ELSE d.name END AS name, d.description,
       d.duration, coalesce(l.remote_support, 'Yes') AS remote_support,
       coalesce(l.adaptive_support, 'No') AS adaptive_support,
       CASE WHEN len(coalesce(l.test_type, []::VARCHAR[])) > 0 THEN l.test_type ELSE d.test_type END AS test_type
FROM listing l JOIN detail d ON l.url = d.url"""
SQL["C10_override_detail"] = B(LISTING_TRUTH, DETAIL_TRUTH) + """
SELECT l.entity_id, l.url, d.name, nullif(d.description, '') AS description, d.duration, l.remote_support, l.adaptive_support,
       CASE WHEN d.test_type <> ['Unknown'] THEN d.test_type ELSE l.test_type END AS test_type
FROM listing l JOIN detail d ON l.url = d.url"""
_MAIN = "regexp_extract(html, " + lit(r"(?is)<main(?:\s[^>]*)?>(.*?)</main>") + ", 1)"
_MAINP = f"list_filter({paragraphs(_MAIN)}, lambda mp: length(mp) > 50)[1]"
_H1 = first_text(drop_invisible("html"), "h1")
SQL["C11_add_missing"] = B(FETCHED) + f"""
SELECT url, coalesce(CASE WHEN {_H1} <> '' THEN {_H1} END, 'Unknown') AS name,
       coalesce({meta_desc('html')}, {_MAINP}) AS description,
       CAST(NULL AS INTEGER) AS duration, 'Yes' AS remote_support, 'No' AS adaptive_support,
       CASE WHEN html IS NULL THEN []::VARCHAR[]
            ELSE {classify(page_text('html'), categories=(), rules=ADD_MISSING_RULES, unknown=None)} END AS test_type,
       [CASE WHEN contains(url, '/solutions/products/') THEN replace(url, '/solutions/products/', '/products/')
             ELSE replace(url, '/products/', '/solutions/products/') END] AS alternate_urls
FROM fetched"""
_JS = f'(SELECT DISTINCT {slug(py_strip(chr(34) + "Assessment_url" + chr(34)))} AS slug FROM jdg)'
_CS = f"(SELECT DISTINCT unnest({variants('url', 'alternate_urls')}) AS slug FROM catx)"
SQL["C12_coverage"] = B() + f"""
SELECT n_judged_slugs, n_catalog_slugs, n_covered, n_judged_slugs - n_covered AS n_missing,
       CASE WHEN n_judged_slugs > 0 THEN n_covered / n_judged_slugs ELSE 0.0 END AS coverage,
       n_items, n_with_alternates,
       CASE WHEN n_items > 0 THEN n_with_alternates / n_items ELSE 0.0 END AS alternates_share
FROM (SELECT (SELECT count(*) FROM {_JS}) AS n_judged_slugs, (SELECT count(*) FROM {_CS}) AS n_catalog_slugs,
             (SELECT count(*) FROM {_JS} j WHERE j.slug IN (SELECT slug FROM {_CS})) AS n_covered,
             (SELECT count(*) FROM catx) AS n_items,
             (SELECT count_if(len(coalesce(alternate_urls, []::VARCHAR[])) > 0) FROM catx) AS n_with_alternates)"""
SQL["C12_missing_slugs"] = B(FETCHED) + f"""
SELECT slug FROM (SELECT DISTINCT {slug(py_strip('u'))} AS slug FROM
  (SELECT "Assessment_url" AS u FROM jdg UNION ALL SELECT url FROM fetched))
WHERE slug NOT IN (SELECT slug FROM {_CS})"""
SQL["C13_lookup_slugs"] = B() + """,
terms AS (SELECT unnest(list_concat(nouns, ['missing-term'])) AS term,
                 unnest(range(len(nouns) + 1)) AS ord FROM lex),
hits AS (SELECT t.term, c.item_id, c.name FROM terms t JOIN catx c ON contains(lower(c.url), t.term))
SELECT t.term, t.ord, CASE WHEN h.n IS NOT NULL THEN 'FOUND' ELSE 'MISSING' END AS status,
       coalesce(h.n, 0) AS n_found, h.first_item_id, h.first_name
FROM terms t LEFT JOIN (SELECT term, count(*) AS n, min(item_id) AS first_item_id,
                               arg_min(name, item_id) AS first_name FROM hits GROUP BY term) h ON t.term = h.term"""
SQL["C13_lookup_judged"] = B() + f"""
, slugs AS (SELECT DISTINCT {slug('"Assessment_url"')} AS term FROM jdg),
terms AS (SELECT DISTINCT term FROM (SELECT term FROM slugs UNION ALL SELECT substring(term, 1, length(term) // 2) FROM slugs
                                     UNION ALL SELECT 'missing-term') WHERE term <> ''),
hits AS (SELECT t.term, c.item_id, c.name FROM terms t JOIN catx c ON contains(lower(c.url), t.term))
SELECT t.term, CASE WHEN h.n IS NOT NULL THEN 'FOUND' ELSE 'MISSING' END AS status,
       coalesce(h.n, 0) AS n_found, h.first_item_id, h.first_name
FROM terms t LEFT JOIN (SELECT term, count(*) AS n, min(item_id) AS first_item_id,
                               arg_min(name, item_id) AS first_name FROM hits GROUP BY term) h ON t.term = h.term"""
SQL["C13_items_with_term"] = B() + """
SELECT c.item_id, c.name, c.url, a.term FROM catx c JOIN (SELECT unnest(adjs) AS term FROM lex) a
  ON contains(lower(c.name), a.term)"""
SQL["C14_completeness_gate"] = B() + f"""
SELECT count(*) AS n_items, count_if(coalesce({py_strip('name')}, '') <> '') AS n_parsed,
       count_if(coalesce({py_strip('name')}, '') = '') AS n_failed, count(*) >= 377 AS passed FROM catx"""

# ---------------------------------------------------------------- D10, D11
_LOW = "lower(text)"
_M = f"TRY_CAST(NULLIF(regexp_extract({_LOW}, '([0-9]+)\\s*(?:mins?|minutes?)', 1), '') AS BIGINT)"
_HR = f"TRY_CAST(NULLIF(regexp_extract({_LOW}, '([0-9]+)\\s*(?:hour|hr)', 1), '') AS BIGINT)"
_HM1 = f"regexp_extract({_LOW}, '([0-9]+)\\s*(?:hour|hr)s?\\s*([0-9]+)\\s*(?:mins?|minutes?)', 1)"
_HM2 = f"regexp_extract({_LOW}, '([0-9]+)\\s*(?:hour|hr)s?\\s*([0-9]+)\\s*(?:mins?|minutes?)', 2)"
_HM = f"(CASE WHEN {_HM1} <> '' THEN TRY_CAST({_HM1} AS BIGINT) * 60 + TRY_CAST({_HM2} AS BIGINT) END)"
SQL["D10_max_duration"] = B() + f"""
SELECT conv_id, turn, list_min(list_filter([{_M}, {_HR}, {_HM}], lambda x: x IS NOT NULL)) AS max_duration
FROM conversations WHERE role = 'user'"""
SQL["D11_resolve_url_queries"] = B() + f""",
q AS (
  SELECT 'c:' || conv_id || ':' || turn AS query_id, {py_strip('text')} AS query FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT 'p:' || page_id, CASE page_id % 10 WHEN 0 THEN url || '?missing' WHEN 2 THEN '' WHEN 3 THEN 'about ' || url
                                            ELSE url END FROM pages
),
every AS (
  SELECT page_id, url, html FROM pages
  UNION ALL SELECT -page_id - 1, url, '<p>older</p>' || html FROM pages WHERE page_id % 5 = 2
),
p AS (SELECT url AS k, {strip_boilerplate(html_to_text('html'), REFERENCE_BOILERPLATE)} AS page_text FROM every
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT query_id, CASE WHEN regexp_matches(query, '^https?://') THEN nullif(page_text, '') ELSE nullif(query, '') END AS query
FROM q LEFT JOIN p ON q.query = p.k"""

# ---------------------------------------------------------------- E1, E2, E4, E5
SQL["E1_doc_text_v1"] = B() + """
SELECT item_id, concat_ws('. ', coalesce(name, ''),
  CASE WHEN coalesce(description, '') <> '' THEN description END,
  CASE WHEN len(coalesce(test_type, []::VARCHAR[])) > 0 THEN 'Test types: ' || array_to_string(test_type, ', ') END,
  CASE WHEN remote_support = 'Yes' THEN 'Supports remote testing' END,
  CASE WHEN adaptive_support = 'Yes' THEN 'Adaptive/IRT assessment' END,
  CASE WHEN coalesce(duration, 0) <> 0 THEN 'Duration: ' || CAST(duration AS VARCHAR) || ' minutes' END) AS text
FROM catx"""
SQL["E2_doc_text_v2"] = B() + """
SELECT item_id, concat_ws(': ',
  CASE WHEN coalesce(name, '') <> '' THEN name END,
  CASE WHEN coalesce(description, '') <> '' THEN description END,
  CASE WHEN contains(coalesce(url, ''), '/view/')
       THEN translate(regexp_replace(string_split(url, '/view/')[-1], '^/+|/+\\z', '', 'g'), '-_', '  ') END,
  CASE WHEN coalesce(duration, 0) <> 0 THEN CAST(duration AS VARCHAR) || ' minutes' END,
  CASE WHEN len(coalesce(test_type, []::VARCHAR[])) > 0 THEN array_to_string(test_type, ', ') END,
  CASE WHEN remote_support = 'Yes' THEN 'remote testing supported' END,
  CASE WHEN adaptive_support = 'Yes' THEN 'adaptive IRT assessment' END) AS text
FROM catx"""
SQL["E4_vector_quality"] = B() + """
SELECT count(*) AS n_total, count_if(NOT (embedding IS NOT NULL AND len(embedding) > 0)) AS n_invalid,
       count(DISTINCT CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 THEN len(embedding) END) AS n_dims
FROM embeddings"""
SQL["E5_l2_normalize"] = B() + """
SELECT vec_id, round(nrm, 6) AS norm,
       list_transform(CASE WHEN nrm = 0 THEN e ELSE list_transform(e, lambda x: x / nrm) END,
                      lambda y: round(y, 6)) AS vec
FROM (SELECT vec_id, embedding::DOUBLE[] AS e,
             sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z))) AS nrm FROM embeddings)"""
