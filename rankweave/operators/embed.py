"""Text -> vector, the embedding hook.

The original called an external embedding model. The default embedder here is TF-IDF over hashed
terms: a term's place is taken from its MD5, which any engine can compute, document frequencies are
a distributed aggregation, and vectors are L2-normalised (E5) and sparse: a struct of the places that a text
has and their weights, as the k-NN operator (E6) takes them. A text of 20 terms is 20 entries from here to the
posting lists of the scan. ``dims`` places are shared by all terms, so terms may collide: similarities
are approximate in that respect only, and more places make collisions rarer.

Any function (DataFrame, text column, output column) -> DataFrame can take its place in
``recommend(embedder=...)``, with sparse or dense vectors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query_text import WORD_RE
from ..session import cut_lineage, written

DIMS = 1024


def term_place(term: Column, dims: int) -> Column:
    """Place of a term: the first 8 hex digits of its MD5, modulo the number of places."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows in as many partitions as there are cores at least: a small file is one split, whatever is done with it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def term_counts(df: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, place, n) of the lower-case words of every text."""
    terms = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_RE), F.lit(0))
    words = spread(df.select(key, text), key).select(F.col(key), F.explode(terms).alias("_t"))
    return words.select(key, term_place(F.col("_t"), dims).alias("place")).groupBy(key, "place").agg(
        F.count(F.lit(1)).alias("n"))


class TermEmbedder(NamedTuple):
    """``idf`` has (place, idf), at most ``dims`` rows; ``counts`` the term counts of the texts that it was fitted on."""
    idf: DataFrame
    dims: int
    counts: DataFrame

    def embed(self, df: DataFrame, key: str, text: str = "text", out: str = "vec", counts: DataFrame | None = None) -> DataFrame:
        """The rows with their normalised sparse vectors; texts without terms have no entries. ``key`` must be unique.

        ``counts`` are the texts' term counts where they are known.
        """
        known = counts if counts is not None else term_counts(df, key, text, self.dims)
        weighed = known.join(F.broadcast(self.idf), "place").select(
            key, "place", (F.col("n") * F.col("idf")).alias("w"))
        # at most dims entries a group
        rows = weighed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("_e"))
        norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
        scaled = F.transform("_e", lambda e: e["w"] / F.when(F.col("_norm") == 0, F.lit(1.0)).otherwise(F.col("_norm")))
        none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<double>").alias("weights"))
        vector = F.struct(F.transform("_e", lambda e: e["place"]).alias("places"), scaled.alias("weights"))
        found = rows.withColumn("_norm", norm).select(key, vector.alias(out))
        return df.join(found, key, "left").withColumn(out, F.coalesce(out, none))

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return self.embed(df, "query_id", text, out)


def fit_term_embedder(docs: DataFrame, key: str, text: str = "text", dims: int = DIMS) -> TermEmbedder:
    """Count the documents that hold each place: idf = ln((documents + 1) / (holding it + 1))."""
    counts = written(term_counts(docs, key, text, dims), "term-counts")
    holding = counts.groupBy("place").agg(F.count(F.lit(1)).alias("df"))
    idf = holding.select("place", F.log((F.lit(float(docs.count())) + 1) / (F.col("df") + 1)).alias("idf"))
    return TermEmbedder(cut_lineage(idf), dims, counts)
