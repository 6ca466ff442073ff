"""Which terms of a table occur in which texts, for any number of terms.

``match_terms`` runs an Aho-Corasick automaton over batches of texts. The term table is read in lots of a bounded
number of bytes; a lot is broadcast as plain terms, each Python worker builds its automaton once, and all
texts pass by. ``contains_join`` is the way without any broadcast: posting lists of one rare gram of each term, an
equi-join on it, and a test of the pairs that meet. Both find what ``contains`` finds: terms as substrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

LOT_BYTES = 32 << 20     # terms of one automaton, in UTF-8
GRAM = 3                 # characters of the grams that terms are looked up by; shorter terms are their own gram

_AUTOMATA: dict = {}     # in a Python worker: the last automaton, by its broadcast's number


def _automaton(terms):
    """The automaton of a broadcast lot, built once in each Python worker."""
    import ahocorasick
    if terms[0] not in _AUTOMATA:
        built = ahocorasick.Automaton()
        for t in terms[1]:
            built.add_word(t, t)
        built.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[terms[0]] = built
    return _AUTOMATA[terms[0]]


def distinct_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """The distinct terms that aren't null or empty, as ``term``."""
    return terms.where(F.length(term) > 0).select(F.col(term).alias("term")).distinct()


def match_terms(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", term: str = "term", lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Distinct (key, term) of the texts that contain a term. Null and empty texts and terms match nothing."""
    spark = texts.sparkSession
    ship_package(spark)
    known = cut_lineage(distinct_terms(terms, term).withColumn("_size", F.octet_length("term") + 1))
    total = known.agg(F.sum("_size").alias("n")).first()["n"] or 0
    lots = max(1, -(-2 * total // lot_bytes)) if total > lot_bytes else 1
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("term", T.StringType())])
    rows = texts.where(F.length(text) > 0).select(key, text)
    out = None
    for k in range(lots):  # of a bounded size each
        lot = known.where(F.pmod(F.xxhash64("term"), F.lit(lots)) == k).select("term") if lots > 1 else known.select("term")
        held = [r["term"] for r in lot.toLocalIterator()]
        part = rows.mapInArrow(_finder(spark.sparkContext.broadcast((hash(tuple(held)), held))), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value[1]:
            return
        automaton = _automaton(sent.value)
        for batch in batches:
            at, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                hits = {t for _, t in automaton.iter(text)}
                at += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())],
                                             [batch.schema.names[0], "term"])
    return run


def grams(text, n: int = GRAM):
    """Distinct grams of n characters; a shorter text has none."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def contains_join(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", term: str = "term") -> DataFrame:
    """Distinct (key, term) of the texts that contain a term, by posting lists of grams: joins only, for tables of any size.

    Each term is looked up by the one of its grams that the fewest texts hold. Keys must be unique.
    """
    known = distinct_terms(terms, term)
    rows = texts.where(F.length(text) > 0).select(key, F.col(text).alias("_text"))
    size = F.least(F.length("term"), F.lit(GRAM))
    own = known.select("term", size.alias("_n"))
    sizes = [r["_n"] for r in own.select("_n").distinct().collect()]  # GRAM rows at most
    if not sizes:
        return rows.select(key, F.lit("").alias("term")).limit(0)
    asked = own.select("term", F.explode(F.coalesce(*[F.when(F.col("_n") == n, grams(F.col("term"), n)) for n in sizes])).alias("gram"))
    lists = rows.select(key, F.explode(F.concat(*[grams(F.col("_text"), n) for n in sizes])).alias("gram"))
    common = lists.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    # a gram that no text holds ends the search for its term
    rare = asked.join(common, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "gram")).alias("r"))
    rare = cut_lineage(rare.where("r.df > 0").select("term", F.col("r.gram").alias("gram")))
    met = lists.join(rare, "gram").select(key, "term").join(rows, key)
    return met.where(F.contains(F.col("_text"), F.col("term"))).select(key, "term")
