"""Operator 1, exact dedup: local, salted, then global combining of equal contents.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Every stage
groups by the digest *and* the whole normalised text, so equality never rests on a digest:

1. each scan task combines its own rows (the map side of the first grouping);
2. rows of the same salt meet: the salt is the scan task's number modulo ``salts``, so a
   content held by a third of all rows is merged by ``salts`` tasks at most one row per
   scan task each;
3. the salts' winners meet, one row per salt and content.

The winners without their texts are checkpointed. Where a digest stands for one content
(all digests, unless SHA-256 collides; a test uses a weak digest), rows find their winner by
digest. Rows of the other digests find it by a join on the whole text.

Defined results: null text is the empty text; null doc_id is smaller than any id; rows equal
in both doc_id and text are copies of which one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import ascii_lower, cut_lineage

SALTS = 16


def sha256_of(text: Column) -> Column:
    """32-byte digest of the UTF-8 text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, norm) -> top doc_id and number of rows, by salted two-level grouping."""
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("salt", "digest", "norm").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("top").alias("top"), F.sum("n").alias("n"))


def _id_key(prefix: str, doc_id: Column) -> list[Column]:
    """doc_id as two never-null join keys."""
    return [doc_id.isNull().alias(f"{prefix}null"), F.coalesce(doc_id, F.lit(0).cast("long")).alias(f"{prefix}id")]


def verdicts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS,
             digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept (and norm for odd digests)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    winners = cut_lineage(_combine(rows, salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("top").alias("keep_id"), F.max("n").alias("group_size")))

    def marked(found: DataFrame, *group: str) -> DataFrame:
        # of rows that repeat the winner's id and text, the first is the one that stays; dealt by
        # id too, so that nothing asks the join to keep a hot digest's rows together
        found = found.repartition("digest", *group, "doc_id")
        w = Window.partitionBy("digest", *group, "doc_id").orderBy("digest")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(w) == 1)
        return found.withColumn("kept", kept).select("doc_id", "digest", "keep_id", "group_size", "kept")

    single = winners.where("contents = 1").drop("contents")
    out = marked(rows.select("doc_id", "digest").join(single, "digest"))
    mixed = winners.where("contents > 1").select("digest")
    if mixed.isEmpty():
        return out
    odd = rows.join(mixed, "digest", "left_semi")
    tops = _combine(odd, salts).select("digest", "norm", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    return out.unionByName(marked(odd.join(tops, ["digest", "norm"]), "norm"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """Verdict of every document, dropped ones too."""
    return verdicts(docs, text_col, id_col, salts).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are matched by (digest, doc_id), of which a group of copies holds many: no key is hot.
    """
    names = docs.columns
    keep = verdicts(docs, text_col, id_col, salts).where("kept").select(
        F.col("digest").alias("k_digest"), *_id_key("k_", F.col("doc_id")))
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                       sha256_of(ascii_lower(F.coalesce(docs[text_col], F.lit("")))).alias("digest"),
                       *_id_key("d_", docs[id_col].cast("long")))
    met = held.join(keep, (F.col("digest") == F.col("k_digest")) & (F.col("d_id") == F.col("k_id"))
                    & (F.col("d_null") == F.col("k_null")), "left_semi")
    w = Window.partitionBy("digest", "d_id", "d_null").orderBy("digest")
    first = met.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return first.select("row.*")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
