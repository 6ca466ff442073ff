"""Operator 4, quality rules: document rules, and host verdicts from shrunk failure rates.

A document fails the base rules when it has fewer than 50 words or when more than half of
its words lie in three-word windows that occur twice or more. Failures are counted by host
(map-side combined, so a host with a third of all rows is no hot key). The hosts' rates are
shrunk with a beta prior whose two parameters are the moments of the rates over all hosts,
and a host whose shrunk rate exceeds ``max_host_rate`` loses its documents.

Everything is DataFrame expressions. A document's counts are computed once and
checkpointed (a few numbers a row); the texts are never shuffled.

Defined results: null or blank text has no words and fails; a null host is a host of its own;
an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import BLANKS, WORD, cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_HOST_RATE = 0.5


def document_rules(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``keep``, and the counts and the base verdict of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc_id")}).items()], text.alias("t"))
    base = base.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    # a window is written with blanks between its words, which hold none: equal text, equal window
    base = base.withColumn("g", F.when(F.col("n_words") >= 4, F.transform(
        F.sequence(F.lit(1), (F.col("n_words") - 2).cast("int")),
        lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))))
    # most texts repeat no window; only the others are sorted
    base = base.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform(
        "g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    base = base.withColumn("p", F.transform(F.filter("s", lambda x, i: (
        F.coalesce(x["g"] == F.try_element_at("s", i + 2)["g"], F.lit(False))
        | ((i > 0) & (x["g"] == F.element_at("s", F.greatest(i, F.lit(1)))["g"])))), lambda x: x["i"]))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    base = base.withColumn("l", lines)
    covered = F.size(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2)))))
    out = base.select(
        *(keep or {"doc_id": 0}), "n_words",
        F.char_length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("p").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: host, host_rate (shrunk), host_failed.

    Moments: with m the mean and v the variance of the hosts' raw rates, a beta prior has the
    weight m(1-m)/v - 1. Without spread between hosts (v = 0) every host gets the mean.
    """
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(F.col("base_failed").cast("long")).alias("bad"))
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = prior["m"], prior["v"]
    if m is None or v <= 1e-12:
        shrunk = F.lit(m or 0.0)
    else:
        weight = max(m * (1 - m) / v - 1, 0.0)
        shrunk = (F.col("bad") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", shrunk.alias("host_rate"), (shrunk > max_host_rate).alias("host_failed"))


def quality_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host: Column | str = "source",
                  max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    host = F.col(host) if isinstance(host, str) else host
    rules = cut_lineage(document_rules(docs, text_col, {"doc_id": F.col(id_col), "host": host}))
    hosts = host_verdicts(rules, max_host_rate)
    # a left join on the host; rows of a large host are split by the adaptive skew join
    found = rules.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
                        F.round("host_rate", 6).alias("host_rate"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k)
            WHERE c > 1 GROUP BY rid),
lines AS (SELECT rid, line FROM d, unnest(string_split(t, chr(10))) AS u(line)
          WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid)),
rules AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM rules GROUP BY source),
moments AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts),
prior AS (SELECT m, v, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0) END AS weight FROM moments),
rates AS (SELECT source, CASE WHEN weight IS NULL THEN m ELSE (bad + m * weight) / (n + weight) END AS r
          FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (r > {MAX_HOST_RATE}) AS kept, round(r, 6) AS host_rate
FROM rules JOIN rates ON rules.source IS NOT DISTINCT FROM rates.source
"""
