"""Helpers shared by the operators: tables, lineage cuts, text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import checkpoint_dir, cut_lineage, release_done, ship_package, written  # noqa: F401  (re-used by the operators)

# fixed values: the ASCII white space of the word contract, as a regex class and as a string
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Prepare a session for operators that run Python on whole documents.

    The package is sent to the workers, and unless the session sets a size of its own, Arrow batches hold
    fewer rows than the default's 10,000, which would be some ten MB of texts at each end of the pipe.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    A text of one byte per character holds ASCII only, where lower() does just that.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    """Number of words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df_columns: list[str], name: str) -> str:
    """A column name that the input doesn't hold yet."""
    taken = {c.lower() for c in df_columns}
    while name.lower() in taken:
        name = "_" + name
    return name
