"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay in Spark: each step joins them with their nodes' smallest neighbour, and the table is
checkpointed once a round. Each partition contracts its own edges first, so a small table is done in a round, and a large one
in few. The smallest node of a component ends up as the centre of all its others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, ship

MOST_NODES = 200_000  # that a task remembers


def contract(edges: Iterator[tuple[list[int], list[int]]], most: int = MOST_NODES) -> Iterator[tuple[list[int], list[int]]]:
    """Lists (u, v) of edges to lists that join the same nodes: every other node of a part with the smallest one, v.

    Whenever more than ``most`` nodes are held, what is known goes out and is forgotten.
    """
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top[x]) != x:
            top[x] = top[up]
            x = up
        return x

    def stars() -> tuple[list[int], list[int]]:
        u = [x for x, up in top.items() if x != up]
        v = [find(x) for x in u]
        top.clear()
        return u, v

    for us, vs in edges:
        for u, v in zip(us, vs, strict=True):
            top.setdefault(u, u)
            top.setdefault(v, v)
            p, q = find(u), find(v)
            if p != q:
                top[max(p, q)] = min(p, q)
        if len(top) > most:
            yield stars()
    yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in contract((batch.column(0).to_pylist(), batch.column(1).to_pylist()) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = edges.join(least, "u")
    if larger_only:
        met = met.where("v > u")
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one v only, which is no other's u. Edges have u > v, and may come twice."""
    sides = edges.select(F.col("u").alias("node"), "v", F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(1).alias("down")))
    held = sides.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("down").alias("down"))
    return held.where("least <> most OR least IS NOT NULL AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, the root being the component's smallest node."""
    ship(edges.sparkSession)
    now = cut_lineage(_contracted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                                  .where("u <> v").distinct()))
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = cut_lineage(_contracted(_to_smallest(_to_smallest(both, True), False)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
