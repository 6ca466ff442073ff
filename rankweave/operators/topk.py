"""Per-group top-k with optional salting for hot groups."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                   rank_col: str = "rank", salt_by: str | None = None,
                   salt_buckets: int = 1) -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order`` and number them 1..k.

    Written as ``row_number() <= k`` so Catalyst inserts a partial
    ``WindowGroupLimit`` before the shuffle. When one group may be very large,
    ``salt_buckets > 1`` first reduces each (group, salt) split to k rows and
    only then ranks the group, so no task ever holds more than
    ``k * salt_buckets`` rows of one group.
    """
    if salt_buckets > 1 and salt_by is not None:
        salt = F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salt_buckets))
        w1 = Window.partitionBy(*keys, salt).orderBy(*order)
        df = (df.withColumn("_pre_rank", F.row_number().over(w1))
              .where(F.col("_pre_rank") <= k).drop("_pre_rank"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
