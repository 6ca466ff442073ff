"""Oracle SQL (DuckDB) for every registered job that SQL can express."""

from __future__ import annotations

from .sqlparts import (D, NAME_L, alt, duration_sql, f1_cte, f2_cte, f3_cte, f5_cte,
                       hybrid_cte, knn_cte, lsum, missed_cte, none_cte, py_strip, recall_ctes, rules_cte,
                       slug, with_base)

KNN = knn_cte(150)
HYB = hybrid_cte()


def _uq_select(cols: str) -> str:
    return with_base() + f"SELECT {cols} FROM uq"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- D
SQL["D1_clean_query"] = _uq_select("query_id, q_clean, q_lower")
SQL["D2_query_duration"] = _uq_select(
    f"query_id, q_duration, {duration_sql('q_lower', 'match')} AS q_duration_match")
SQL["D3_query_skills"] = _uq_select("query_id, skills")
SQL["D4_query_roles"] = _uq_select("query_id, roles")
SQL["D5_tag_prefs"] = _uq_select("query_id, tag_prefs")
SQL["D6_expand_query"] = _uq_select("query_id, job_terms, expanded")
SQL["D7_boost_keywords"] = _uq_select("query_id, boost_terms")
SQL["D8_boost_tokens"] = _uq_select("query_id, q_words, boost_tokens")
SQL["D3_lexicon_table"] = _uq_select("query_id, q_duration, skills, roles, tag_prefs, expanded, boost_terms, boost_tokens, fb_skills, fb_roles")
SQL["D9_fallback_terms"] = _uq_select("query_id, fb_skills, fb_roles")

# ---------------------------------------------------------------- E
SQL["E6_knn_top10"] = with_base(knn_cte(10)) + "SELECT query_id, item_id, sim, sem_rank FROM knn"

# ---------------------------------------------------------------- F
SQL["F1_retrieve_basic"] = with_base(KNN, f1_cte("f1", 20)) + "SELECT query_id, item_id, score, rank FROM f1"
SQL["F2_retrieve_semantic"] = with_base(KNN, f2_cte("f2", 10)) + \
    "SELECT query_id, item_id, score, rank FROM f2"
SQL["F3_retrieve_boosted"] = with_base(KNN, f3_cte("f3", 10)) + \
    "SELECT query_id, item_id, boost, score, rank FROM f3"
SQL["F4_hybrid_retrieve"] = with_base(KNN, HYB) + \
    "SELECT query_id, item_id, sim, keyword_score, hybrid_score, hybrid_rank FROM hyb"
SQL["F5_keyword_retrieve"] = with_base(KNN, f5_cte("f5", 20)) + "SELECT query_id, item_id, score, rank FROM f5"
SQL["F6_soft_penalties"] = with_base(KNN, HYB) + "SELECT query_id, item_id, hybrid_rank, combined_score FROM pen"
SQL["F7_rerank_rules"] = with_base(KNN, HYB, rules_cte(None)) + \
    "SELECT query_id, item_id, rerank_score, final_score, rank FROM ruled"
SQL["F8_recommend_rules"] = with_base(KNN, HYB, rules_cte(10)) + \
    "SELECT query_id, rank, item_id, url, final_score FROM ruled"
SQL["F8_recommend_none"] = with_base(KNN, HYB, none_cte("nonek", 10)) + \
    "SELECT query_id, rank, item_id, url, final_score FROM nonek"

_FUSE = f"""
fu AS (
  SELECT query_id, url, item_id, rank, final_score{D} AS score, 0 AS src FROM s0
  UNION ALL SELECT query_id, url, item_id, rank, score{D}, 1 FROM s1
  UNION ALL SELECT query_id, url, item_id, rank, score{D}, 2 FROM s2
  UNION ALL SELECT query_id, url, item_id, rank, score{D}, 3 FROM s3
),
fg AS (
  SELECT query_id, url, list(score ORDER BY score DESC) AS scores,
         list(rank ORDER BY src, rank) AS ranks,
         arg_min(item_id, src * 1000000 + rank) AS item_id, min(src) AS first_src,
         arg_min(rank, src * 1000000 + rank) AS first_rank
  FROM fu GROUP BY query_id, url
),
fz AS (
  SELECT *, CASE WHEN len(scores) >= 2 THEN scores[1] * 0.7{D} + scores[2] * 0.3{D} ELSE scores[1] END
              AS ensemble_score,
         list_reduce(list_prepend(0.0{D}, list_transform(ranks, lambda r: 1.0{D} / (60 + r))),
                     lambda a, b: a + b) AS rrf_score,
         ensemble_score * 0.7{D} + rrf_score * 0.3{D} AS final_score,
         len(scores) AS n_lists,
         row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, first_src, first_rank, item_id) AS rank
  FROM fg
  QUALIFY rank <= 10
)"""
SQL["F9_ensemble"] = with_base(KNN, HYB, rules_cte(20, name="s0"), f3_cte("s1", 20), f1_cte("s2", 20),
                               f5_cte("s3", 20), _FUSE) + \
    "SELECT query_id, item_id, ensemble_score, rrf_score, final_score, n_lists, rank FROM fz"

def _ext_slug(u: str) -> str:
    return (f"(CASE WHEN contains({u}, '/view/') THEN regexp_replace(string_split({u}, '/view/')[-1], '/+\\z', '') "
            f"ELSE {u} END)")


def external_ctes(k: int) -> str:
    """ext: the listed URLs; xr: the first k of the merge (query_id, item_id, from_external, rank)."""
    return f"""
ext AS (
  SELECT query_id, rank AS pos,
         CASE WHEN rank % 3 = 0 THEN 'https://mirror.example.org/catalog/view/' || {slug('url')} || '/'
              WHEN rank % 3 = 1 THEN {alt('url')} ELSE url END AS ext_url
  FROM f3x
  UNION ALL
  SELECT query_id, rank + 10, 'https://mirror.example.org/catalog/view/' || regexp_extract({slug('url')}, '^[^-]+') FROM f3x
  UNION ALL
  SELECT query_id, rank + 20, CASE WHEN rank % 2 = 0 THEN {alt('url')} ELSE url END FROM f3x
),
cands AS (SELECT * FROM pen WHERE hybrid_rank <= {2 * k}),
ent AS (
  SELECT query_id, list({{'u': u, 'item_id': item_id}} ORDER BY part, hybrid_rank, item_id, nth) AS e FROM (
    SELECT query_id, url AS u, item_id, 0 AS part, hybrid_rank, 0 AS nth FROM cands
    UNION ALL
    SELECT query_id, alternate_urls[n], item_id, 1, hybrid_rank, n
    FROM cands, unnest(range(1, len(coalesce(alternate_urls, []::VARCHAR[])) + 1)) AS r(n))
  WHERE u IS NOT NULL GROUP BY query_id
),
lst AS (SELECT query_id, list(ext_url ORDER BY pos) AS l FROM ext GROUP BY query_id),
walk AS (
  SELECT ent.query_id, e, l, 0 AS i, []::VARCHAR[] AS seen, []::BIGINT[] AS picks
  FROM ent JOIN lst ON ent.query_id = lst.query_id
  UNION ALL
  SELECT query_id, e, l, i + 1, CASE WHEN hit IS NULL THEN seen ELSE list_append(seen, hit.u) END,
         CASE WHEN hit IS NULL THEN picks ELSE list_append(picks, hit.item_id) END
  FROM (SELECT *, coalesce(
          list_filter(e, lambda x: x.u = l[i + 1] AND NOT list_contains(seen, l[i + 1]))[1],
          list_filter(e, lambda x: contains(x.u, {_ext_slug('l[i + 1]')}) AND NOT list_contains(seen, x.u))[1]) AS hit
        FROM walk WHERE i < len(l))
),
listed AS (
  SELECT query_id, item_id, 0 AS src, min(n) AS ord
  FROM (SELECT query_id, unnest(picks) AS item_id, unnest(range(1, len(picks) + 1)) AS n FROM walk WHERE i = len(l))
  GROUP BY query_id, item_id
),
merged AS (
  SELECT * FROM listed
  UNION ALL
  SELECT c.query_id, c.item_id, 1, c.hybrid_rank FROM cands c
  WHERE NOT EXISTS (SELECT 1 FROM listed x WHERE x.query_id = c.query_id AND x.item_id = c.item_id)
),
xr AS (
  SELECT query_id, item_id, src = 0 AS from_external,
         row_number() OVER (PARTITION BY query_id ORDER BY src, ord, item_id) AS rank
  FROM merged QUALIFY rank <= {k}
),
xc AS (SELECT c.* , xr.rank FROM xr JOIN cands c ON xr.query_id = c.query_id AND xr.item_id = c.item_id)"""


def with_walk(*ctes: str) -> str:
    return with_base(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


SQL["F10_external_ranking"] = with_walk(KNN, HYB, f3_cte("f3x", 10), external_ctes(10)) + \
    "SELECT query_id, item_id, rank, from_external FROM xr"
SQL["F8_recommend_external"] = with_walk(KNN, HYB, f3_cte("f3x", 10), external_ctes(10)) + \
    "SELECT query_id, rank, item_id, url, combined_score AS final_score FROM xc"
SQL["F1_max_duration"] = with_base(KNN, f1_cte("f1", 20, "coalesce(duration, 0) <= 25")) + \
    "SELECT query_id, item_id, score, rank FROM f1"

_FB = ("((combined_score + " + lsum("fb_skills", f"CASE WHEN contains({NAME_L}, t) THEN 0.20{D} ELSE 0.0{D} END")
       + ") + " + lsum("fb_roles", f"CASE WHEN contains({NAME_L}, t) THEN 0.15{D} ELSE 0.0{D} END") + ")")
SQL["F11_rerank_fallback"] = with_base(KNN, HYB) + f"""
SELECT query_id, rank, item_id, final_score FROM (
  SELECT *, {_FB} AS final_score,
         row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, hybrid_rank, item_id) AS rank
  FROM pen) WHERE rank <= 10"""

_LINE = ("CAST(hybrid_rank AS VARCHAR) || '. ' || coalesce(name, 'Unknown') || chr(10) || '   Description: ' "
         "|| substring(coalesce(description, ''), 1, 150) || '...' || chr(10) || '   Test Types: ' "
         "|| (CASE WHEN len(coalesce(test_type, []::VARCHAR[])) > 0 THEN array_to_string(test_type, ', ') "
         "ELSE 'Unknown' END) || chr(10) "
         "|| (CASE WHEN coalesce(duration, 0) <> 0 THEN '   Duration: ' || CAST(coalesce(duration, 0) AS VARCHAR) "
         "|| ' minutes' || chr(10) ELSE '' END) || '   URL: ' || url || chr(10) || chr(10)")
SQL["F12_rerank_prompt"] = with_base(KNN, HYB) + f"""
SELECT query_id, string_agg({_LINE}, '' ORDER BY hybrid_rank) AS prompt, count(*) AS n_candidates
FROM pen WHERE hybrid_rank <= 20 GROUP BY query_id"""

_REPLIES = f"""
rep0 AS (SELECT query_id, list(url ORDER BY rank) AS urls FROM f3x GROUP BY query_id),
replies AS (
  SELECT query_id,
    CASE WHEN query_id % 3 = 0 THEN '```json' || chr(10) || '["' || array_to_string(urls, '", "') || '"]' || chr(10) || '```'
         WHEN query_id % 3 = 1 THEN '["' || array_to_string(urls, '", "') || '"]'
         ELSE 'Ranking: ' || array_to_string(urls, ', then ') || ' end' END AS reply
  FROM rep0
),
parsed AS (
  SELECT query_id, {py_strip('reply')} AS t,
    {py_strip("regexp_extract(t, '(?s)```json(.*?)(?:```|\\z)', 1)")} AS after_json,
    list_filter(string_split(t, '```'), lambda p: starts_with({py_strip('p')}, '[')
                                             OR starts_with({py_strip('p')}, '{{'))[1] AS bracketed,
    CASE WHEN contains(t, '```json') THEN after_json
         WHEN contains(t, '```') THEN coalesce({py_strip('bracketed')}, t) ELSE t END AS body
  FROM replies
)"""
SQL["F13_parse_ranking_response"] = with_base(KNN, f3_cte("f3x", 10), _REPLIES) + r"""
SELECT query_id,
  CASE WHEN json_valid(body) AND json_type(body::JSON) = 'ARRAY' AND len(from_json(body, '["VARCHAR"]')) > 0
         THEN from_json(body, '["VARCHAR"]')
       WHEN json_valid(body) THEN []::VARCHAR[]
       ELSE regexp_extract_all(body, 'https?://[^\s,\]]+') END AS urls
FROM parsed"""

SQL["F14_format_response"] = with_base(KNN, HYB, rules_cte(10)) + """
SELECT q.query_id,
  CASE WHEN coalesce(r.n, 0) = 0 THEN 'not_found' WHEN r.n < 5 THEN 'too_few' ELSE 'ok' END AS status,
  coalesce(r.n, 0) AS n_results, coalesce(r.urls, []::VARCHAR[]) AS urls
FROM qry q LEFT JOIN (SELECT query_id, count(*) AS n, list(url ORDER BY rank) AS urls FROM ruled
                      GROUP BY query_id) r ON q.query_id = r.query_id"""

SQL["F14_response_items"] = with_base(KNN, HYB, rules_cte(10)) + """
SELECT query_id, rank - 1 AS pos, url, coalesce(name, 'Unknown') AS name, coalesce(adaptive_support, 'No') AS adaptive_support,
       coalesce(description, '') AS description, coalesce(duration, 0) AS duration, coalesce(remote_support, 'No') AS remote_support,
       coalesce(test_type, []::VARCHAR[]) AS test_type
FROM ruled"""

# ---------------------------------------------------------------- H
_H1 = [KNN, HYB, rules_cte(10), recall_ctes("ruled", "h1")]
SQL["H1_recall_at_k"] = with_base(*_H1) + "SELECT query_id, n_relevant, n_hits, recall, has_results FROM h1"
SQL["H2_mean_recall"] = with_base(*_H1) + "SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall FROM h1"
SQL["H2_mean_recall_skip"] = with_base(*_H1) + \
    "SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall FROM h1 WHERE has_results"
SQL["H3_recall_stats"] = with_base(*_H1) + """
SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, min(recall) AS min_recall,
       max(recall) AS max_recall, count_if(recall = 0) AS n_zero, count_if(recall = 1) AS n_full,
       count_if(recall < 0.5) AS n_below_50, count_if(recall < 0.3) AS n_below_30 FROM h1"""

_STRATS = ["rules", "none", "boosted", "basic", "semantic", "keyword"]
_H4 = [KNN, HYB, rules_cte(10), none_cte("nonek", 10), f3_cte("sb", 10), f1_cte("sa", 10), f2_cte("ss", 10),
       f5_cte("sk", 10), """
st AS (
  SELECT 'rules' AS strategy, query_id, url, alternate_urls, rank FROM ruled
  UNION ALL SELECT 'none', query_id, url, alternate_urls, rank FROM nonek
  UNION ALL SELECT 'boosted', query_id, url, alternate_urls, rank FROM sb
  UNION ALL SELECT 'basic', query_id, url, alternate_urls, rank FROM sa
  UNION ALL SELECT 'semantic', query_id, url, alternate_urls, rank FROM ss
  UNION ALL SELECT 'keyword', query_id, url, alternate_urls, rank FROM sk
)""", recall_ctes("st", "h4", by_col="strategy", by_values=_STRATS)]
SQL["H4_compare_strategies"] = with_base(*_H4) + """
SELECT strategy, n_queries, round(mean_recall, 6) AS mean_recall, position, position = 1 AS is_best,
       round(mean_recall - max(CASE WHEN strategy = 'semantic' THEN mean_recall END) OVER (), 6)
         AS gain_over_baseline
FROM (SELECT *, row_number() OVER (ORDER BY mean_recall DESC, strategy) AS position
      FROM (SELECT strategy, count(*) AS n_queries, avg(recall) AS mean_recall FROM h4 GROUP BY strategy))"""

_DEPTHS = [10, 15, 20, 30, 50]
_H5 = [KNN, f"""
sweep AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY depth, query_id ORDER BY score DESC, sem_rank, item_id) AS rank
    FROM (SELECT *, unnest({_DEPTHS}) AS depth FROM (
            SELECT *, round(sim + {__import__('oracle.sqlparts', fromlist=['F1_BOOST']).F1_BOOST}, 6) AS score
            FROM ({__import__('oracle.sqlparts', fromlist=['pairs']).pairs('sem_rank <= 150')})))
    WHERE sem_rank <= depth * 3
  ) WHERE rank <= 10 AND rank <= depth
)""", recall_ctes("sweep", "h5", by_col="depth", by_values=_DEPTHS)]
SQL["H5_sweep_depth"] = with_base(*_H5) + """
SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n_queries, round(avg(recall), 6) AS mean_recall
FROM h5 GROUP BY depth"""

_H6 = _H1 + [missed_cte("h1")]
SQL["H6_miss_analysis"] = with_base(*_H6) + \
    'SELECT query_id, "Assessment_url", slug, name, recall, n_hits, n_relevant FROM missed'
SQL["H6_worst_queries"] = with_base(*_H1) + "SELECT query_id, recall FROM h1 ORDER BY recall, query_id LIMIT 5"
SQL["H7_top_missed"] = with_base(*_H6) + \
    "SELECT name, count(*) AS n_missed FROM missed GROUP BY name ORDER BY n_missed DESC, name LIMIT 10"
SQL["H8_low_recall_patterns"] = with_base(*_H1, """
low AS (SELECT h1.query_id, q.query FROM h1 JOIN qry q ON h1.query_id = q.query_id WHERE h1.recall < 0.5)""") + """
SELECT (SELECT count(*) FROM low) AS n_low, n AS pattern,
       (SELECT count_if(contains(lower(low.query), n)) FROM low) AS n_queries
FROM (SELECT unnest(nouns) AS n FROM lex)"""
SQL["H9_suggestions"] = with_base(*_H6) + """
SELECT ord, issue, suggestion FROM (
  SELECT 1::BIGINT AS ord, CAST(n AS VARCHAR) || ' queries have recall < 30%' AS issue,
         'Widen the query vocabulary or use an embedder fitted to the domain' AS suggestion, n
  FROM (SELECT count_if(recall < 0.3) AS n FROM h1)
  UNION ALL
  SELECT 2::BIGINT, CAST(n AS VARCHAR) || ' queries missing >5 relevant assessments',
         'Retrieve deeper, or find candidates that share meaning rather than words', n
  FROM (SELECT count_if((n_relevant - n_hits) > 5) AS n FROM h1)
  UNION ALL
  SELECT 3::BIGINT, 'Most frequently missed assessments: ' || coalesce(string_agg(slug, ', ' ORDER BY c DESC, slug), ''),
         'Check the names and descriptions of these items',
         count(*)
  FROM (SELECT slug, count(*) AS c FROM missed GROUP BY slug ORDER BY c DESC, slug LIMIT 3)
) WHERE n > 0"""

SQL["H10_before_after"] = with_base(KNN, HYB, rules_cte(10), none_cte("nonek", 10),
                                    recall_ctes("nonek", "hb"), recall_ctes("ruled", "ha")) + """
SELECT coalesce(b.query_id, a.query_id) AS query_id, b.recall AS recall_before, a.recall AS recall_after,
       a.recall - b.recall AS delta
FROM hb b FULL OUTER JOIN ha a ON b.query_id = a.query_id"""

SQL["H10_external"] = with_walk(KNN, HYB, none_cte("nonek", 10), f3_cte("f3x", 10), external_ctes(10),
                                recall_ctes("nonek", "hb"), recall_ctes("xc", "ha")) + """
SELECT coalesce(b.query_id, a.query_id) AS query_id, b.recall AS recall_before, a.recall AS recall_after,
       a.recall - b.recall AS delta
FROM hb b FULL OUTER JOIN ha a ON b.query_id = a.query_id"""
SQL["H10_ensemble"] = with_base(KNN, HYB, rules_cte(20, name="s0"), f3_cte("s1", 20), f1_cte("s2", 20), f5_cte("s3", 20),
                                _FUSE, rules_cte(10), """
fe AS (SELECT fz.query_id, fz.url, fz.rank, c.alternate_urls FROM fz JOIN catx c ON fz.item_id = c.item_id)""",
                                recall_ctes("ruled", "hb"), recall_ctes("fe", "ha")) + """
SELECT coalesce(b.query_id, a.query_id) AS query_id, b.recall AS recall_before, a.recall AS recall_after,
       a.recall - b.recall AS delta
FROM hb b FULL OUTER JOIN ha a ON b.query_id = a.query_id"""

# ---------------------------------------------------------------- I
_I = [KNN, HYB, rules_cte(10), """
pred AS (SELECT r.query_id, q.query AS "Query", r.url AS "Assessment_url", r.rank
         FROM ruled r JOIN qry q ON r.query_id = q.query_id)"""]
SQL["I1_batch_predict"] = with_base(*_I) + 'SELECT query_id, "Query", "Assessment_url", rank FROM pred'
SQL["I2_prediction_stats"] = with_base(*_I) + """
SELECT count(*) AS n_predictions, count(DISTINCT "Query") AS n_queries,
       count(*) / count(DISTINCT "Query") AS mean_per_query FROM pred"""
SQL["I3_validate_predictions"] = with_base(*_I) + """
SELECT 'columns' AS "check", true AS passed, 'Query,Assessment_url' AS detail
UNION ALL SELECT 'non_empty', count(*) > 0, CAST(count(*) AS VARCHAR) FROM pred
UNION ALL SELECT 'urls_http', count_if(NOT starts_with(coalesce("Assessment_url", ''), 'http')) = 0,
                 CAST(count_if(NOT starts_with(coalesce("Assessment_url", ''), 'http')) AS VARCHAR) FROM pred
UNION ALL SELECT 'queries_covered', count(*) = 0, CAST(count(*) AS VARCHAR)
  FROM (SELECT DISTINCT query AS "Query" FROM qry) e
  WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p."Query" = e."Query")"""
SQL["I4_result_summary"] = with_base(KNN, HYB, rules_cte(10)) + """
SELECT query_id, avg(CASE WHEN coalesce(duration, 0) > 0 THEN coalesce(duration, 0) END) AS avg_duration,
       count_if(remote_support = 'Yes') AS n_remote, count_if(adaptive_support = 'Yes') AS n_adaptive,
       count(*) AS n_results
FROM ruled GROUP BY query_id"""
SQL["I5_result_table"] = with_base(KNN, HYB, rules_cte(10)) + """
SELECT query_id, rank AS "Rank", name AS "Name", coalesce(duration, 0) AS "Duration",
       CASE WHEN len(coalesce(test_type, []::VARCHAR[])) > 0 THEN array_to_string(test_type, ', ')
            ELSE 'Unknown' END AS "Test_Type",
       remote_support AS "Remote_Support", adaptive_support AS "Adaptive", url AS "URL"
FROM ruled"""


# ---------------------------------------------------------------- D with the reference lexicon
def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _lst(vals) -> str:
    return "[" + ", ".join(_q(v) for v in vals) + "]::VARCHAR[]"


def _reference_lexicon_sql(source: str = "SELECT conv_id || ':' || turn AS query_id, text AS query "
                                          "FROM conversations WHERE role = 'user'") -> str:
    from rankweave.functions.lexicon import reference_lexicon
    from .sqlparts import WORD, clean_sql, duration_sql, ordered_distinct
    lx = reference_lexicon()
    concepts = "[" + ", ".join("{'c': %s, 'v': %s}" % (_q(c), _lst(v)) for c, v in lx.concepts) + "]"
    roles = "[" + ", ".join("{'c': %s, 'v': %s}" % (_q(c), _lst(v)) for c, v in lx.roles) + "]"
    tag_rules = "[" + ", ".join("{'t': %s, 'v': %s}" % (_lst(t), _lst(v)) for t, v in lx.tag_rules) + "]"
    job_rules = "[" + ", ".join("{'t': %s, 'v': %s}" % (_lst(t), _lst(v)) for t, v in lx.job_rules) + "]"
    hit = "lambda r: len(list_filter(r.{f}, lambda x: contains(q_lower, x))) > 0"
    return f"""
WITH t AS ({source}),
u AS (
  SELECT query_id, lower(query) AS q_raw_lower, {clean_sql('query')} AS q_clean, lower(q_clean) AS q_lower,
    {duration_sql('q_lower')} AS q_duration,
    flatten(list_transform(list_filter({concepts}, {hit.format(f='v')}), lambda r: r.v)) AS skills_raw,
    {ordered_distinct('skills_raw')} AS skills,
    list_transform(list_filter({roles}, {hit.format(f='v')}), lambda r: r.c) AS roles,
    flatten(list_transform(list_filter({tag_rules}, {hit.format(f='t')}), lambda r: r.v)) AS tag_prefs,
    flatten(list_transform(list_filter({job_rules}, {hit.format(f='t')}), lambda r: r.v)) AS job_terms,
    array_to_string(list_concat([q_clean],
        list_filter(skills[1:8], lambda s: NOT contains(q_lower, s)),
        list_filter(roles[1:5], lambda s: NOT contains(q_lower, s)),
        list_filter(job_terms[1:3], lambda s: NOT contains(q_lower, s))), ' ') AS expanded,
    list_filter({_lst(lx.boost_terms)}, lambda x: contains(q_raw_lower, x)) AS boost_terms,
    list_sort(list_intersect(list_distinct(regexp_extract_all(q_raw_lower, '{WORD}')), {_lst(lx.token_terms)}))
      AS boost_tokens,
    list_filter({_lst(lx.fallback_skills)}, lambda x: contains(q_raw_lower, x)) AS fb_skills,
    list_filter({_lst(lx.fallback_roles)}, lambda x: contains(q_raw_lower, x)) AS fb_roles
  FROM t
)
SELECT query_id, q_duration, skills, roles, tag_prefs, expanded, boost_terms, boost_tokens, fb_skills, fb_roles
FROM u"""


SQL["D3_reference_lexicon"] = _reference_lexicon_sql()
SQL["D3_reference_lexicon_documents"] = _reference_lexicon_sql("SELECT doc_id AS query_id, text AS query FROM documents")
SQL["D3_lexicon_table_documents"] = SQL["D3_reference_lexicon_documents"]
