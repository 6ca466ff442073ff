"""DuckDB SQL building blocks for the correctness oracle.

Each helper returns SQL text. The oracle restates every adaptor view and
operator independently in SQL over the pre-registered input tables, so a
Spark result and its oracle only agree when both compute the same thing.
"""

from __future__ import annotations

WS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
LONG = "/solutions/products/product-catalog/view/"
SHORT = "/products/product-catalog/view/"
HOST = "https://shop.example.com"
WORD = r"[\p{L}\p{N}_]+"
D = "::DOUBLE"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def rstrip_slashes(x: str) -> str:
    return f"regexp_replace({x}, '/+\\z', '')"


def decode(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '%28', '('), '%29', ')'), '%20', ' '), '%2d', '-')"


def slug(u: str, marker: str = "/view/") -> str:
    norm = rstrip_slashes(py_strip(f"lower({u})"))
    after = f"string_split({norm}, '{marker}')[-1]"
    return (f"(CASE WHEN {u} IS NULL OR {u} = '' THEN '' "
            f"WHEN contains({norm}, '{marker}') THEN {decode(rstrip_slashes(after))} "
            f"ELSE {norm} END)")


def alt(u: str) -> str:
    return (f"(CASE WHEN {u} IS NULL OR {u} = '' THEN {u} "
            f"WHEN contains(lower({u}), '{LONG}') THEN replace({u}, '{LONG}', '{SHORT}') "
            f"WHEN contains(lower({u}), '{SHORT}') THEN replace({u}, '{SHORT}', '{LONG}') "
            f"ELSE {u} END)")


def for_comparison(u: str) -> str:
    x = decode(f"replace({rstrip_slashes(u)}, '/solutions/products/', '/products/')")
    return f"(CASE WHEN {u} IS NULL OR {u} = '' THEN '' ELSE lower({x}) END)"


def variants(u: str, alts: str) -> str:
    a = alt(u)
    every = (f"list_concat([{u}], coalesce({alts}, []::VARCHAR[]), "
             f"CASE WHEN {a} <> {u} THEN [{a}] ELSE []::VARCHAR[] END)")
    return f"list_sort(list_distinct(list_transform({every}, lambda z: {slug('z')})))"


def norm_vec(v: str) -> str:
    dv = f"{v}::DOUBLE[]"
    nrm = f"sqrt(list_sum(list_transform({dv}, lambda y: y * y)))"
    return f"(CASE WHEN {nrm} = 0 THEN {dv} ELSE list_transform({dv}, lambda x: x / {nrm}) END)"


CAT = f"""
cat AS (
  SELECT p.p_partkey AS item_id,
    (CASE WHEN p.p_partkey % 2 = 0 THEN '{HOST}{SHORT}' ELSE '{HOST}{LONG}' END)
      || replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS VARCHAR) || '/' AS url,
    p.p_name AS name,
    CASE WHEN p.p_partkey % 7 = 0 THEN NULL
         ELSE 'for ' || lower(p.p_type) || ' work; ' || p.p_brand || ' '
              || string_split(p.p_name, ' ')[1] || ' finish' END AS description,
    CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE p.p_size END AS duration,
    CASE WHEN p.p_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS remote_support,
    CASE WHEN p.p_partkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS adaptive_support,
    CASE WHEN p.p_partkey % 13 = 0 THEN [p.p_type, 'Unknown'] ELSE [p.p_type] END AS test_type,
    {norm_vec('e.embedding')} AS vec,
    e.label AS label
  FROM part p JOIN embeddings e ON p.p_partkey = e.vec_id
),
catx AS (
  SELECT *, CASE WHEN item_id % 5 = 0 THEN []::VARCHAR[] ELSE [{alt('url')}] END AS alternate_urls
  FROM cat
)"""

QRY = """
qry AS (
  SELECT c.item_id AS query_id,
    CASE c.item_id % 5
      WHEN 0 THEN 'need ' || c.name || ' for ' || lower(p.p_type) || ' work, max '
                  || CAST(p.p_size AS VARCHAR) || ' minutes'
      WHEN 1 THEN 'looking for a ' || c.name || ', about ' || CAST(p.p_size AS VARCHAR)
                  || ' mins, ' || lower(p.p_type) || ' grade'
      WHEN 2 THEN c.name || ' kit for ' || lower(p.p_type) || ' use in ' || CAST(p.p_size AS VARCHAR)
                  || '-' || CAST(p.p_size + 10 AS VARCHAR) || ' minutes'
      WHEN 3 THEN 'senior ' || string_split(c.name, ' ')[-1] || ' for ' || lower(p.p_type)
                  || ' tasks within 1 hour'
      ELSE 'entry level  ' || c.name || '  for remote ' || lower(p.p_type) || ' jobs' END AS query,
    c.vec AS qvec, c.label AS label
  FROM cat c JOIN part p ON c.item_id = p.p_partkey
)"""

JDG = """
jdg AS (
  SELECT q.query_id, q.query AS "Query",
    CASE WHEN c.item_id % 2 = 1 AND len(c.alternate_urls) > 0 THEN c.alternate_urls[1]
         ELSE c.url END AS "Assessment_url"
  FROM qry q JOIN catx c
    ON q.label = c.label AND c.item_id <> q.query_id
)"""

LEX = """
lexw AS (
  SELECT lower(string_split(p_name, ' ')[1]) AS adj, lower(string_split(p_name, ' ')[-1]) AS noun,
         p_type AS ptype FROM part
),
lex AS (
  SELECT (SELECT list(DISTINCT noun ORDER BY noun) FROM lexw WHERE noun IS NOT NULL AND noun <> '') AS nouns,
         (SELECT list(DISTINCT adj ORDER BY adj) FROM lexw WHERE adj IS NOT NULL AND adj <> '') AS adjs,
         (SELECT list(DISTINCT ptype ORDER BY ptype) FROM lexw WHERE ptype IS NOT NULL AND ptype <> '') AS types
)"""


def duration_sql(ql: str, unit_scope: str = "query") -> str:
    pats = [r"([0-9]+)\s*minutes?", r"([0-9]+)\s*mins?", r"([0-9]+)\s*hours?", r"([0-9]+)\s*hrs?",
            r"duration[:\s]*([0-9]+)", r"max[:\s]*([0-9]+)", r"about\s*([0-9]+)"]
    hour_any = f"(contains({ql}, 'hour') OR contains({ql}, 'hr'))"
    parts = []
    for i, p in enumerate(pats):
        v = f"TRY_CAST(NULLIF(regexp_extract({ql}, '{p}', 1), '') AS BIGINT)"
        if unit_scope == "query":
            v = f"CASE WHEN {hour_any} THEN {v} * 60 ELSE {v} END"
        elif i in (2, 3):
            v = f"{v} * 60"
        parts.append(v)
    return "coalesce(" + ", ".join(parts) + ")"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def clean_sql(q: str) -> str:
    x = py_strip(f"regexp_replace({q}, '{WS}+', ' ', 'g')")
    return f"replace(replace({x}, 'Java Script', 'JavaScript'), 'java script', 'javascript')"


def ws_words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> ''))"


STOPWORDS = "['the', 'a', 'an', 'for', 'and', 'or', 'to', 'in', 'of', 'is', 'are']"

# Understood queries for the derived lexicon.
UQ = f"""
uq AS (
  SELECT q.query_id, q.qvec, q.query, q.label,
    lower(q.query) AS q_raw_lower,
    {clean_sql('q.query')} AS q_clean,
    lower(q_clean) AS q_lower,
    {duration_sql('q_lower')} AS q_duration,
    flatten(list_transform(list_filter(lex.nouns, lambda n: contains(q_lower, n) OR contains(q_lower, n || 's')),
                           lambda n: [n, n || 's'])) AS skills_raw,
    {ordered_distinct('skills_raw')} AS skills,
    list_filter(lex.adjs, lambda a: contains(q_lower, a)) AS roles,
    list_concat(list_filter(lex.types, lambda t: contains(q_lower, lower(t))),
                CASE WHEN contains(q_lower, 'kit') OR contains(q_lower, 'grade')
                     THEN ['STANDARD', 'PROMO'] ELSE []::VARCHAR[] END) AS tag_prefs,
    list_concat(
      CASE WHEN contains(q_lower, 'entry') OR contains(q_lower, 'graduate')
           THEN ['entry level', 'junior', 'graduate'] ELSE []::VARCHAR[] END,
      CASE WHEN contains(q_lower, 'senior') OR contains(q_lower, 'experienced')
           THEN ['senior', 'experienced', 'professional'] ELSE []::VARCHAR[] END,
      CASE WHEN contains(q_lower, 'manager') THEN ['management'] ELSE []::VARCHAR[] END,
      CASE WHEN contains(q_lower, 'analyst') THEN ['data analysis'] ELSE []::VARCHAR[] END) AS job_terms,
    array_to_string(list_concat([q_clean],
        list_filter(skills[1:8], lambda s: NOT contains(q_lower, s)),
        list_filter(roles[1:5], lambda s: NOT contains(q_lower, s)),
        list_filter(job_terms[1:3], lambda s: NOT contains(q_lower, s))), ' ') AS expanded,
    lower(expanded) AS expanded_lower,
    list_filter(list_concat(lex.nouns, lex.adjs), lambda t: contains(q_raw_lower, t)) AS boost_terms,
    list_sort(list_distinct(regexp_extract_all(q_raw_lower, '{WORD}'))) AS q_words,
    list_sort(list_intersect(q_words, list_concat(lex.nouns, lex.adjs))) AS boost_tokens,
    list_filter(lex.nouns, lambda t: contains(q_raw_lower, t)) AS fb_skills,
    list_filter(lex.adjs, lambda t: contains(q_raw_lower, t)) AS fb_roles
  FROM qry q CROSS JOIN lex
)"""


def knn_cte(depth: int, name: str = "knn") -> str:
    """Exact top-``depth`` by inner product of normalised vectors, with item payload."""
    return f"""
{name} AS (
  SELECT q.query_id, c.*, round(list_dot_product(q.qvec, c.vec), 6) AS sim,
         row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(q.qvec, c.vec), 6) DESC,
                            c.item_id) AS sem_rank
  FROM uq q CROSS JOIN catx c
  QUALIFY sem_rank <= {depth}
)"""


NAME_L = "lower(name)"
DESC_L = "lower(coalesce(description, ''))"


def lsum(lst: str, lam: str) -> str:
    return f"coalesce(list_sum(list_transform({lst}, lambda t: {lam})), 0.0{D})"


def pairs(depth_filter: str, knn: str = "knn") -> str:
    """Candidate pair rows: knn rows within depth joined with the understood query."""
    return (f"SELECT k.* EXCLUDE (vec), u.q_raw_lower, u.q_clean, u.q_lower, u.q_duration, u.skills, "
            f"u.roles, u.tag_prefs, u.expanded_lower, u.boost_terms, u.boost_tokens, u.q_words, "
            f"u.fb_skills, u.fb_roles FROM {knn} k JOIN uq u USING (query_id) WHERE {depth_filter}")


HYBRID_KW = (
    "((((" + lsum("skills", f"CASE WHEN contains({NAME_L}, t) THEN 0.40{D} WHEN contains({DESC_L}, t) THEN 0.10{D} ELSE 0.0{D} END")
    + " + " + lsum("roles", f"CASE WHEN contains({NAME_L}, t) THEN 0.30{D} WHEN contains({DESC_L}, t) THEN 0.10{D} ELSE 0.0{D} END")
    + ") + " + lsum("skills", f"CASE WHEN contains(expanded_lower, t) AND contains({NAME_L}, t) THEN 0.20{D} ELSE 0.0{D} END")
    + ") + " + lsum("tag_prefs", f"CASE WHEN list_contains(test_type, t) THEN 0.20{D} ELSE 0.0{D} END")
    + f") + len(list_filter(list_intersect({ws_words('expanded_lower')}, {ws_words(NAME_L)}), "
    f"lambda w: NOT list_contains({STOPWORDS}, w))) * 0.15{D})"
)


def hybrid_cte(pool: int = 100, depth: int = 150) -> str:
    return f"""
hyb AS (
  SELECT *, round({HYBRID_KW}, 6) AS keyword_score, round(sim + {HYBRID_KW}, 6) AS hybrid_score,
         row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, sem_rank, item_id) AS hybrid_rank
  FROM ({pairs(f'sem_rank <= {depth}')})
  QUALIFY hybrid_rank <= {pool}
),
pen AS (
  SELECT *, ((hybrid_score
      * (CASE WHEN q_duration IS NOT NULL AND q_duration <> 0 AND coalesce(duration, 0) > 0
                   AND coalesce(duration, 0) > q_duration * 1.3 THEN 0.9{D} ELSE 1.0{D} END))
      * (CASE WHEN len(tag_prefs) > 0 AND len(list_filter(tag_prefs, lambda t: list_contains(test_type, t))) = 0
              THEN 0.95{D} ELSE 1.0{D} END)) AS combined_score
  FROM hyb
)"""


def any_contains(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


RULE_SCORE = (
    "((((((" + lsum("skills", f"CASE WHEN contains({NAME_L}, t) THEN 0.30{D} ELSE 0.0{D} END")
    + " + " + lsum("roles", f"CASE WHEN contains({NAME_L}, t) THEN 0.25{D} ELSE 0.0{D} END")
    + f") + (CASE WHEN q_duration IS NOT NULL AND q_duration <> 0 AND duration IS NOT NULL AND duration <> 0 "
    f"AND duration <= q_duration * 1.2 THEN 0.15{D} ELSE 0.0{D} END))"
    + " + " + lsum("tag_prefs", f"CASE WHEN list_contains(test_type, t) THEN 0.10{D} ELSE 0.0{D} END")
    + f") + (CASE WHEN {any_contains('q_lower', ['entry', 'graduate', 'junior', '0-2', '0-3'])} "
    f"AND {any_contains(NAME_L, ['entry', 'junior', 'level'])} THEN 0.10{D} ELSE 0.0{D} END))"
    + f" + (CASE WHEN {any_contains('q_lower', ['senior', 'experienced', '5+', 'years'])} "
    f"AND {any_contains(NAME_L, ['senior', 'advanced', 'professional'])} THEN 0.10{D} ELSE 0.0{D} END))"
    + f" + (CASE WHEN contains(q_lower, 'remote') AND remote_support = 'Yes' THEN 0.05{D} ELSE 0.0{D} END))"
)


def rules_cte(k: int | None = 10, src: str = "pen", name: str = "ruled") -> str:
    qualify = f"QUALIFY rank <= {k}" if k is not None else ""
    return f"""
{name} AS (
  SELECT *, round({RULE_SCORE}, 6) AS rerank_score, combined_score + {RULE_SCORE} AS final_score,
         row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, hybrid_rank, item_id) AS rank
  FROM {src}
  {qualify}
)"""


BASE = ",".join([CAT, QRY, JDG, LEX, UQ])


def with_base(*ctes: str) -> str:
    return "WITH " + ",".join([BASE, *ctes]) + "\n"


# ---------------------------------------------------------------- ranking CTEs

F1_BOOST = lsum("boost_terms", f"CASE WHEN contains({NAME_L}, t) THEN 0.15{D} "
                               f"WHEN contains({DESC_L}, t) THEN 0.05{D} ELSE 0.0{D} END")
F3_BOOST = ("(" + lsum("boost_tokens", f"CASE WHEN contains({NAME_L}, t) THEN 0.3{D} "
                                       f"WHEN contains({DESC_L}, t) THEN 0.1{D} ELSE 0.0{D} END")
            + " + " + lsum("q_words", f"CASE WHEN length(t) > 3 AND contains({NAME_L}, t) "
                                      f"THEN 0.15{D} ELSE 0.0{D} END") + ")")
F5_KW = ("(((" + lsum("skills", f"CASE WHEN contains({NAME_L}, t) THEN 0.30{D} ELSE 0.0{D} END")
         + " + " + lsum("roles", f"CASE WHEN contains({NAME_L}, t) THEN 0.25{D} ELSE 0.0{D} END")
         + ") + " + lsum("skills", f"CASE WHEN contains({DESC_L}, t) THEN 0.10{D} ELSE 0.0{D} END")
         + ") + " + lsum("skills", f"CASE WHEN contains(q_raw_lower, t) AND contains({NAME_L}, t) "
                                   f"THEN 0.15{D} ELSE 0.0{D} END") + ")")


def f1_cte(name: str, k: int, keep: str = "true") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, round({F1_BOOST}, 6) AS boost, round(sim + {F1_BOOST}, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sem_rank, item_id) AS rank
    FROM ({pairs(f'sem_rank <= {3 * k} AND {keep}')})
  ) WHERE rank <= {k}
)"""


def f2_cte(name: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, sim AS score, row_number() OVER (PARTITION BY query_id ORDER BY sem_rank) AS rank FROM (
      SELECT * FROM knn WHERE sem_rank <= {2 * k}
      QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY sem_rank) = 1)
  ) WHERE rank <= {k}
)"""


def f3_cte(name: str, k: int, depth: int = 100) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, round({F3_BOOST}, 6) AS boost, round(sim + {F3_BOOST}, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sem_rank, item_id) AS rank
    FROM ({pairs(f'sem_rank <= {depth}')})
    QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY sem_rank) = 1
  ) WHERE rank <= {k}
)"""


def f5_cte(name: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, keyword_score AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, sem_rank, item_id) AS rank
    FROM (SELECT *, round({F5_KW}, 6) AS keyword_score FROM ({pairs(f'sem_rank <= {2 * k}')}))
    WHERE keyword_score > 0
  ) WHERE rank <= {k}
)"""


def none_cte(name: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT *, hybrid_rank AS rank, combined_score AS final_score FROM pen WHERE hybrid_rank <= {k}
)"""


# ---------------------------------------------------------------- evaluation CTEs

def recall_ctes(ranked: str, prefix: str, k: int = 10, by_col: str | None = None,
                by_values=None, jdg: str = "jdg") -> str:
    """CTEs {prefix}_det (relevant slug rows with hit) and {prefix} (per-query recall)."""
    if by_col:
        vals = ", ".join(repr(v) for v in by_values)
        jsrc = f"(SELECT *, unnest([{vals}]) AS {by_col} FROM {jdg})"
        keys = f"{by_col}, query_id"
        on = f"a.{by_col} = b.{by_col} AND a.query_id = b.query_id"
    else:
        jsrc, keys, on = jdg, "query_id", "a.query_id = b.query_id"
    return f"""
{prefix}_rel AS (SELECT DISTINCT {keys}, {slug(py_strip('"Assessment_url"'))} AS slug FROM {jsrc}),
{prefix}_rec AS (SELECT DISTINCT {keys}, unnest({variants('url', 'alternate_urls')}) AS slug
                 FROM {ranked} WHERE rank <= {k}),
{prefix}_det AS (SELECT a.*, b.slug IS NOT NULL AS hit FROM {prefix}_rel a
                 LEFT JOIN {prefix}_rec b ON {on} AND a.slug = b.slug),
{prefix}_per AS (SELECT {keys}, count(*) AS n_relevant, count_if(hit) AS n_hits
                 FROM {prefix}_det GROUP BY {keys}),
{prefix}_seen AS (SELECT DISTINCT {keys} FROM {ranked}),
{prefix} AS (SELECT a.*, b.query_id IS NOT NULL AS has_results,
                    CASE WHEN n_relevant > 0 THEN n_hits / n_relevant ELSE 0.0{D} END AS recall
             FROM {prefix}_per a LEFT JOIN {prefix}_seen b ON {on})"""


def missed_cte(prefix: str = "h1", name: str = "missed") -> str:
    return f"""
names AS (
  SELECT u, name FROM (SELECT unnest(list_concat([url], coalesce(alternate_urls, []::VARCHAR[]))) AS u,
                              name, item_id FROM catx)
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY item_id) = 1
),
jl AS (SELECT query_id, "Assessment_url", {slug(py_strip('"Assessment_url"'))} AS slug,
              {py_strip('"Assessment_url"')} AS u FROM jdg),
{name} AS (
  SELECT jl.query_id, jl."Assessment_url", jl.slug, coalesce(names.name, 'Unknown') AS name,
         p.recall, p.n_hits, p.n_relevant
  FROM jl JOIN (SELECT query_id, slug FROM {prefix}_det WHERE NOT hit) d
       ON jl.query_id = d.query_id AND jl.slug = d.slug
  LEFT JOIN names ON jl.u = names.u
  JOIN {prefix} p ON jl.query_id = p.query_id
)"""


def bigint_counts(sql: str) -> str:
    """Wrap every count_if(...) in CAST(... AS BIGINT): DuckDB returns HUGEINT, Spark bigint."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k
