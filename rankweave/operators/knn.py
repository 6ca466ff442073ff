"""Exact inner-product top-k (E4, E6) over groups of items that bounds can skip.

1. **Groups.** The valid item vectors are written to the shared folder once. A bounded sample of them gives the
   pivots; each item belongs to the group of its nearest pivot (dense) or heaviest place (sparse), large groups
   are cut into parts of a bounded number of rows. One aggregate gives each group's extent: its radius round the
   pivot, or the largest weight of each place.
2. **Floors and bounds.** A query's k-th best score within the sample is a floor of its k-th best score of all.
   Where a group's extent bounds its scores below the floor, the query doesn't go there. This is exact: no
   answer is lost, and where nothing can be skipped the query meets every group.
3. **Scan.** Group parts are put together to slabs, queries dealt into blocks, and a task is a slab and a block. An
   item moves once to each block, a query once to each slab with a group that it can't skip. In a task the items come
   first and are held, the queries stream past them in batches; the floor rises from group to group, so that groups
   are skipped by the best scores so far. A task holds one slab and one batch.
4. The rows that reach the floor (at most ``k`` per query and slab) are reduced with ``row_number() <= k``.
   Then the item columns are joined to the result.

Slabs and blocks are chosen so that little moves (``_deal``): copies of items cost as many as there are blocks, answers
``k`` rows a slab. A slab is bounded in bytes. What goes through the
driver is the sample and the extents, of a fixed size. Scores are rounded to 6 decimals once, in the scan, and
ranked by (score, item id) everywhere, so the result doesn't depend on groups, sample or partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import is_valid_vector
from ..session import ship_package, written
from .topk import topk_per_group
from .vectors import Best, kernel_of

GROUP_ROWS = 65_536         # items of a group part
LEAST_GROUP_ROWS = 256
TASK_PAIRS = 1 << 34        # (query, item) pairs of a task at most, down to LEAST_GROUP_ROWS
SAMPLE_ROWS = 2_048         # items that give pivots and floors
TASKS_PER_CORE = 4          # groups made at least, so that small tables use all cores
BATCH_ROWS = 2_048          # routed query rows of an Arrow batch
SALT_PARTS = 64             # slabs per salt bucket of the final top-k
SLAB_BYTES = 1 << 27        # vectors of a slab at most, if it is more than one group part
BLOCK_ROWS = 256            # queries of a block at least
ANSWER_BYTES = 24           # of a (query, item, score) row


def drop_invalid_vectors(items: DataFrame, vec: str = "vec") -> DataFrame:
    """Remove rows whose vector is null or empty."""
    return items.where(_valid(items, vec))


def vector_quality(items: DataFrame, vec: str = "vec") -> DataFrame:
    """E4 report: total rows, invalid rows, and the number of distinct dimensions."""
    valid = is_valid_vector(F.col(vec))
    return items.agg(F.count(F.lit(1)).alias("n_total"),
                     F.count_if(~valid).alias("n_invalid"),
                     F.countDistinct(F.when(valid, F.size(vec))).alias("n_dims"))


def _valid(df: DataFrame, vec: str):
    """Sparse vectors without places are zero vectors, and valid."""
    return F.col(vec).isNotNull() if df.schema[vec].dataType.typeName() == "struct" else is_valid_vector(F.col(vec))


def _vectors(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    sparse = df.schema[vec].dataType.typeName() == "struct"
    kind = "struct<places:array<int>,weights:array<double>>" if sparse else "array<double>"
    return df.where(_valid(df, vec)).select(F.col(key).alias(name), F.col(vec).cast(kind).alias("_v"))


class Groups(NamedTuple):
    """``pivots`` and the k-NN floor come from ``sample``; ``extents`` has a row, ``parts`` a number for each group."""
    sample: object
    pivots: object
    extents: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray

    @property
    def n_parts(self) -> int:
        return int(self.parts.sum())


def _plan_groups(items: DataFrame, kernel, n_queries: int, group_rows: int, sample_rows: int) -> Groups | None:
    """Sample, pivots, and one pass over the items for sizes and extents; None without items."""
    n = items.count()
    if not n:
        return None
    group_rows = max(min(group_rows, LEAST_GROUP_ROWS), min(group_rows, TASK_PAIRS // max(1, n_queries)))
    drawn = items.orderBy(F.xxhash64("_iid"), "_iid").limit(sample_rows).toArrow().column("_v")  # bounded
    sample = kernel.read(drawn)
    least = TASKS_PER_CORE * items.sparkSession.sparkContext.defaultParallelism
    n_groups = max(1, min(len(sample), max(math.ceil(2 * n / group_rows), min(least, n // LEAST_GROUP_ROWS))))
    pivots = kernel.take(sample, np.arange(n_groups))

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, most = np.zeros(n_groups, dtype=np.int64), {}
        for batch in batches:
            if batch.num_rows:
                x = kernel.read(batch.column(0))
                home = kernel.home(x, pivots)
                sizes += np.bincount(home, minlength=n_groups)
                for g, e in kernel.extent(x, home, pivots).items():
                    most[g] = np.maximum(most[g], e) if g in most else e
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array([int(sizes[g]) for g in most], pa.int64()),
                                          pa.array([e.tobytes() for e in most.values()], pa.binary())], ["g", "n", "e"])

    def joined(table: pa.Table) -> pa.Table:
        most = np.stack([np.frombuffer(e) for e in table.column("e").to_pylist()]).max(axis=0)
        return pa.table({"g": table.column("g")[:1], "n": pa.array([int(np.sum(table.column("n").to_numpy()))]), "e": pa.array([most.tobytes()], pa.binary())})

    found = items.select("_v").mapInArrow(extents, "g long, n long, e binary").groupBy("g").applyInArrow(
        joined, "g long, n long, e binary").collect()  # one row for each pivot at most
    sizes, width = np.zeros(n_groups, dtype=np.int64), len(np.frombuffer(found[0]["e"]))
    table = np.zeros((n_groups, width))
    for r in found:
        sizes[r["g"]], table[r["g"]] = r["n"], np.frombuffer(r["e"])
    return Groups(sample, pivots, table, sizes, -(-sizes // group_rows))


def _route_items(items: DataFrame, kernel, groups) -> DataFrame:
    """(_part, _iid, _v): every item once, with its group part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = groups.value
        first = np.cumsum(g.parts) - g.parts
        for batch in batches:
            if batch.num_rows:
                home = kernel.home(kernel.read(batch.column("_v")), g.pivots)
                part = first[home] + batch.column("_salt").to_numpy() % np.maximum(g.parts[home], 1)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("_iid"), batch.column("_v")], ["_part", "_iid", "_v"])

    schema = T.StructType([T.StructField("_part", T.IntegerType()), items.schema["_iid"], items.schema["_v"]])
    return items.withColumn("_salt", F.xxhash64("_iid")).mapInArrow(run, schema)


def _route_queries(queries: DataFrame, kernel, groups, k: int, slab: np.ndarray | None = None) -> DataFrame:
    """(_part, _qid, _v, _floor): every query for each group part that it can't skip, or with ``slab`` (_slab, ...) for each slab."""
    to = "_part" if slab is None else "_slab"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = groups.value
        first = np.cumsum(g.parts) - g.parts
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(a, BATCH_ROWS)
                q = kernel.read(batch.column("_v"))
                kernel.same_space(q, g.sample)
                floor = np.full(len(q), -np.inf)
                if k <= len(g.sample):
                    floor = kernel.kth(q, g.sample, k)
                row, group = np.nonzero((kernel.bounds(q, g.pivots, g.extents) >= floor[:, None]) & (g.sizes > 0))
                times = g.parts[group]
                part = np.repeat(first[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = np.repeat(row, times)
                if slab is not None:
                    row, part = np.divmod(np.unique(row * (int(slab.max()) + 1) + slab[part]), int(slab.max()) + 1)
                for b in range(0, len(row), BATCH_ROWS):
                    at = pa.array(row[b:b + BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[b:b + BATCH_ROWS].astype(np.int32)), batch.column("_qid").take(at), batch.column("_v").take(at),
                         pa.array(floor[row[b:b + BATCH_ROWS]])], [to, "_qid", "_v", "_floor"])

    schema = T.StructType([T.StructField(to, T.IntegerType()), queries.schema["_qid"], queries.schema["_v"],
                           T.StructField("_floor", T.DoubleType())])
    return queries.mapInArrow(run, schema)


class Deal(NamedTuple):
    """``slab`` of each group part, and the number of slabs and of query blocks."""
    slab: np.ndarray
    slabs: int
    blocks: int


def _deal(groups: Groups, row_bytes: int, n_queries: int, k: int, tasks: int) -> Deal:
    """Consecutive group parts to slabs of about equal rows, so many that slabs x blocks are ``tasks`` and little moves."""
    rows = np.repeat(groups.sizes / np.maximum(groups.parts, 1), groups.parts)
    moved = len(rows) and rows.sum() * row_bytes * tasks / (max(1, n_queries) * (row_bytes + k * ANSWER_BYTES))
    most = max(1, math.ceil(n_queries / BLOCK_ROWS))
    slabs = int(min(len(rows), max(math.ceil(rows.sum() * row_bytes / SLAB_BYTES), round(math.sqrt(moved)), math.ceil(tasks / most))))
    before = np.cumsum(rows) - rows
    slab = np.minimum((before / max(rows.sum(), 1) * slabs).astype(np.int32), slabs - 1)
    return Deal(slab, slabs, min(math.ceil(tasks / slabs), most))


def _dealt(routed: DataFrame, asking: DataFrame, deal: Deal) -> DataFrame:
    """(_task, _part, _iid, _v) of the items and (_task, _qid, _v, _floor) of the queries, each task in one partition, items first by part."""
    slabs = F.array(*[F.lit(int(x)) for x in deal.slab])
    items = routed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(deal.blocks - 1)))).select(
        (F.get(slabs, F.col("_part")) * deal.blocks + F.col("_block")).alias("_task"), "_part", "_iid", "_v")
    block = F.pmod(F.xxhash64("_qid", "_v"), F.lit(deal.blocks)).cast("int")
    queries = asking.select((F.col("_slab") * deal.blocks + block).alias("_task"), "_qid", "_v", "_floor")
    both = items.unionByName(queries, allowMissingColumns=True)
    return both.repartitionById(deal.slabs * deal.blocks, F.col("_task")).sortWithinPartitions(F.col("_part").asc_nulls_last())


def _scan(kernel, k: int, names: list[str], sent):
    """Items of a slab first, by group part and id, then the block's queries in batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        group_of = np.repeat(np.arange(len(g.parts)), g.parts)
        ids, of, vectors, held = [], [], [], None
        for batch in batches:
            side = batch.column("_part").is_null().to_numpy(zero_copy_only=False)
            n_items = int(np.count_nonzero(~side))
            if n_items:
                ids.append(batch.column("_iid").slice(0, n_items))
                of.append(batch.column("_part").slice(0, n_items).to_numpy())
                vectors.append(kernel.read(batch.column("_v").slice(0, n_items)))
            if n_items == batch.num_rows or not ids:
                continue
            if held is None:
                known, part = pa.concat_arrays(ids), np.concatenate(of)
                order = np.empty(len(known), dtype=np.int64)   # places of the ids, equal scores go by it
                order[pc.sort_indices(known).to_numpy()] = np.arange(len(known))
                by_id = np.lexsort((order, part))              # kernels take rows in order of their ids
                known, part, order = known.take(pa.array(by_id)), part[by_id], order[by_id]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                x = kernel.join(vectors)
                vectors, held = [], [(a, group_of[part[a]], kernel.take(x, by_id[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                del x
            for a in range(n_items, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(a, BATCH_ROWS)
                q = kernel.read(piece.column("_v"))
                kernel.same_space(q, held[0][2])
                bounds = kernel.bounds(q, g.pivots, g.extents)
                best = Best(len(q), k, piece.column("_floor").to_numpy(), order)
                # groups with the largest bounds first: they raise the floor for the others
                for first, group, x in sorted(held, key=lambda h: -float(bounds[:, h[1]].mean())):  # noqa: B023
                    rows = np.flatnonzero(bounds[:, group] >= best.floor)
                    if len(rows):
                        for row, place, score in kernel.above(kernel.take(q, rows), x, k, lambda: best.floor[rows]):  # noqa: B023
                            best.add((rows[row], first + place, score))
                row, place, score = best.settle()
                yield pa.RecordBatch.from_arrays([piece.column("_qid").take(pa.array(row)), known.take(pa.array(place)), pa.array(score)], names)
    return run


class Prepared(NamedTuple):
    """Item vectors written to the shared folder, and their groups (None without items)."""
    table: DataFrame
    kernel: type
    groups: Groups | None


def prepare_items(items: DataFrame, iid: str = "item_id", ivec: str = "vec", n_queries: int = 1, group_rows: int = GROUP_ROWS,
                  sample_rows: int = SAMPLE_ROWS) -> Prepared:
    """What E6 needs to know about the items; to be kept where many query tables meet the same items."""
    ship_package(items.sparkSession)
    kernel = kernel_of(items.schema[ivec].dataType)
    table = written(_vectors(items, iid, ivec, "_iid"), "knn-items")
    return Prepared(table, kernel, _plan_groups(table, kernel, n_queries, group_rows, sample_rows))


def _prepared(queries: DataFrame, items: DataFrame, k: int, qid: str, qvec: str, iid: str, ivec: str, group_rows: int,
              sample_rows: int, prepared: Prepared | None = None):
    """(kernel, groups, routed items, routed queries, number of queries); groups None without items."""
    spark = queries.sparkSession
    q = _vectors(queries, qid, qvec, "_qid")
    n_queries = None
    if prepared is None:
        n_queries = q.count()
        prepared = prepare_items(items, iid, ivec, n_queries, group_rows, sample_rows)
    table, kernel, groups = prepared
    if groups is None:
        return kernel, None, None, None, n_queries
    sent = spark.sparkContext.broadcast(groups)  # the sample and a row for each pivot: bounded
    return kernel, groups, _route_items(table, kernel, sent), _route_queries(q, kernel, sent, k), n_queries


def partial_topk(queries: DataFrame, items: DataFrame, k: int, *, qid: str, qvec: str, iid: str, ivec: str,
                 score_col: str, group_rows: int = GROUP_ROWS, sample_rows: int = SAMPLE_ROWS,
                 prepared: Prepared | None = None) -> tuple[DataFrame, int]:
    """At most ``k`` rows (qid, iid, score) of each query and slab, and the number of slabs."""
    struct = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(iid, items.schema[iid].dataType),
                           T.StructField(score_col, T.DoubleType())])
    spark = queries.sparkSession
    q = _vectors(queries, qid, qvec, "_qid")
    n_queries = q.count()
    if prepared is None:
        prepared = prepare_items(items, iid, ivec, n_queries, group_rows, sample_rows)
    table, kernel, groups = prepared
    if groups is None:
        return spark.createDataFrame([], struct), 0
    sent = spark.sparkContext.broadcast(groups)  # the sample and a row for each pivot: bounded
    deal = _deal(groups, kernel.row_bytes(groups.sample), n_queries, k, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    dealt = _dealt(_route_items(table, kernel, sent), _route_queries(q, kernel, sent, k, deal.slab), deal)
    return dealt.mapInArrow(_scan(kernel, k, struct.names, sent), struct), deal.slabs


def pruning_report(queries: DataFrame, items: DataFrame, k: int, *, qid: str = "query_id", qvec: str = "qvec", iid: str = "item_id",
                   ivec: str = "vec", group_rows: int = GROUP_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row: queries, items, group parts, (query, item) pairs, pairs that the scan looks at and the share skipped."""
    spark = queries.sparkSession
    _, groups, routed, asking, n_queries = _prepared(queries, items, k, qid, qvec, iid, ivec, group_rows, sample_rows)
    schema = "n_queries long, n_items long, n_parts long, n_pairs long, n_scanned long, skipped_share double"
    if groups is None:
        return spark.createDataFrame([(n_queries, 0, 0, 0, 0, 0.0)], schema)
    size = routed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    scanned = asking.groupBy("_part").agg(F.count(F.lit(1)).alias("q")).join(size, "_part").agg(
        F.coalesce(F.sum(F.col("n") * F.col("q")), F.lit(0)).alias("n_scanned"))
    n_items = int(groups.sizes.sum())
    pairs = n_queries * n_items
    return scanned.select(F.lit(n_queries).cast("long").alias("n_queries"), F.lit(n_items).cast("long").alias("n_items"),
                          F.lit(groups.n_parts).cast("long").alias("n_parts"), F.lit(pairs).cast("long").alias("n_pairs"), "n_scanned",
                          (1 - F.col("n_scanned") / F.lit(float(max(pairs, 1)))).alias("skipped_share"))


def knn_topk(queries: DataFrame, items: DataFrame, k: int, *, qid: str = "query_id",
             qvec: str = "qvec", iid: str = "item_id", ivec: str = "vec",
             score_col: str = "sim", rank_col: str = "sem_rank", group_rows: int = GROUP_ROWS,
             sample_rows: int = SAMPLE_ROWS, prepared: Prepared | None = None) -> DataFrame:
    """Exact inner-product top-k items per query (cosine when both sides are L2-normalised).

    Vectors are ``array<double>`` on both sides, or sparse structs of places and weights on both sides.
    Returns one row per (query, item) kept: ``qid``, ``score_col`` (rounded to 6 decimals),
    ``rank_col`` (1..k) and every item column except ``ivec``. Rows without a valid vector on either
    side take no part (E4). Item ids must be unique. ``prepared`` items (``prepare_items`` of the same
    ``items``) aren't written and grouped again.
    """
    part, n_parts = partial_topk(queries, items, k, qid=qid, qvec=qvec, iid=iid, ivec=ivec, score_col=score_col,
                                 group_rows=group_rows, sample_rows=sample_rows, prepared=prepared)
    out = topk_per_group(part, [qid], [F.col(score_col).desc(), F.col(iid).asc()], k, rank_col=rank_col,
                         salt_by=iid, salt_buckets=max(1, n_parts // SALT_PARTS))
    rest = [c for c in items.columns if c not in (iid, ivec)]
    if rest:
        # the join is on the item; per-query windows and joins downstream reuse this partitioning
        out = out.join(items.select(iid, *rest), iid, "inner").repartition(qid)
    return out.select(qid, score_col, rank_col, iid, *rest)
