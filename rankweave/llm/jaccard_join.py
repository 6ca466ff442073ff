"""Operator 9, n-gram Jaccard join by set relations: which documents hang together at 80 %.

Documents with the same shingle set are one *set*. Two sets link when 100 times their
intersection is at least 80 times their union; documents get their component's smallest id.

1. **Answers of similar sets.** Near copies meet by band keys; in each key's group the set that
   shares most keys leads (aggregates only), and a set whose exact overlap with its leader
   makes a link joins that leader's *star*, together with the overlap. What hangs together by these links
   has one *root*, and all links inside it are settled: a large group of near copies is never paired out.
2. **Index.** In a fixed order (shingles frequent in a sample last), sets that link share one of
   their first 20 % shingles. One pass over the texts makes sizes, band keys and these first shingles. A list of one root
   is passed over. In others entries stand in blocks of similar size, in a block by what still follows them: blocks and
   tails of blocks whose position leaves too few shingles are skipped, and only entries outside the list's
   largest root are looked up.
3. **Derived answers.** For a pair of sets x and y that met, the overlap of their leaders P and Q is
   computed first. Overlap(x, y) differs from it by at most what x and P, and y and Q, don't share, which
   settles most pairs; those left open are compared themselves. Before any texts move, parity
   bitmaps rule out pairs whose overlap they bound below a link.
4. **Crowded lists.** Where a list has more than CROWDED pairs an entry, no pair leaves its task: the list's members are
   dealt into tiles of similar sizes, and two tiles meet in a task. First their parity bitmaps meet: sets that come
   from the same shingle before the list's have met there, and members of the largest such lot aren't brought
   together. Only sets that may link with another go on as whole sets to their two tiles, are compared there, and only
   links that join what hasn't hung together in the task before come out.

Only texts that are compared move; the order of shingles is the only thing taken from a sample, and it doesn't
touch the results. Links never go to the driver.

Defined results: null, empty and blank texts have no shingles and link with nothing (component_id is
their own doc_id); texts of under five words are one shingle; rows without an id take part and
get the smallest id of their component (null if there is none); repeated rows hang together; an empty
table gives an empty result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, release_done, ship, written
from rankweave.llm.components import components
from rankweave.llm.shingles import BANDS, Shingler, apart, bands, parity, prefix_length, set_id

PERCENT = 80
SAMPLE_DOCS, MAX_FREQUENT = 32_000, 200_000  # bound of what the order of shingles is fitted on
CROWDED, TILE = 2, 256   # pairs an entry that a list may give out; members of a tile
MAP_BITS = 1 << 21
NO_ID = -(1 << 63)


def _linked(inter, a, b):
    return 100 * inter >= PERCENT * (a + b - inter)


def first_of(s: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The first shingles of a set in the order: those that aren't frequent, then the others by their counts."""
    hashes, counts = order
    if len(hashes):
        at = np.searchsorted(hashes, s) % len(hashes)
        s = s[np.argsort(np.where(hashes[at] == s, counts[at], 0), kind="stable")]
    return s[:prefix_length(len(s), PERCENT)].tobytes()


def scan(docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, sid, n, b0..b7, first) of every row: the set's number, size, band keys and first shingles in the order.

    Without shingles sid, band keys and first are null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sids, sizes, keys, firsts = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingler.set_of(raw or b"")
                sizes.append(len(s))
                sids.append(set_id(s) if len(s) else None)
                keys.append(bands(s) if len(s) else [None] * BANDS)
                firsts.append(first_of(s, order) if len(s) else None)
            columns = [batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array([k[b] for k in keys], pa.int64()) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(firsts, pa.binary())], ["doc_id", "sid", "n", *[f"b{b}" for b in range(BANDS)], "first"])

    schema = "doc_id long, sid long, n long, " + ", ".join(f"b{b} long" for b in range(BANDS)) + ", first binary"
    return docs.mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, their counts) of shingles seen twice or more in a bounded sample of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.set_of(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 24)) / float(1 << 24)
    sample = docs.where(draw < min(1.0, SAMPLE_DOCS / max(n_docs, 1)))  # so many on average
    counts = cut_lineage(sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    least, held = 2, 0
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():  # SAMPLE_DOCS rows at most
        held += r["n"]
        if held > MAX_FREQUENT:
            least = r["c"] + 1
            break
    found = counts.where(F.col("c") >= least).toPandas()  # at most MAX_FREQUENT rows
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found["c"].to_numpy()[order]


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` and ``marked``: true for every key that stands in ``keys``, and by chance for some others.

    The marks are a bitmap of a fixed size, as a table of at most MAP_BITS / 64 words: they're looked up without leaving
    the JVM, and no row moves for it.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(MAP_BITS))
    words = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    placed = rows.withColumn("slot", slot).withColumn("word", F.expr("slot div 64"))
    bit = F.expr("shiftright(bits, cast(slot % 64 as int)) & 1") == 1
    return placed.join(F.broadcast(words), "word", "left").withColumn("marked", F.coalesce(bit, F.lit(False))).drop("word", "slot", "bits")


def _asked(asked: DataFrame, sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (key, text) that may hold one of the sets asked for (sid), and these sets' numbers (sid, key).

    Marks leave most other rows out before they are joined.
    """
    wanted = cut_lineage(sets.join(asked, "sid").select("sid", F.coalesce("rep", F.lit(NO_ID)).alias("key")))
    some = _marked(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text"), wanted)
    return some.where("marked").select("key", "text"), wanted


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()


def possible(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sets' parity bitmaps don't rule out.

    Bits that differ are shingles that only one of two sets has, so a bitmap bounds the overlap from
    above: no link is lost, and sets that share a passage only needn't be compared by their texts.
    """
    pairs = cut_lineage(pairs.distinct())
    rows, wanted = _asked(_both(pairs), sets, docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = [shingler.set_of(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_id(s) if len(s) else None for s in found], pa.int64()),
                 pa.array([len(s) for s in found], pa.int64()), pa.array([parity(s).tobytes() for s in found], pa.binary())],
                ["key", "sid", "n", "bits"])

    sketches = rows.mapInArrow(sketch, "key long, sid long, n long, bits binary").join(wanted, ["key", "sid"]).select("sid", "n", "bits")
    side = lambda c: sketches.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            bits = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            fits = [(m + n - apart(x, y)) // 2 >= _needed(m, n) for (m, n), (x, y) in zip(sizes, bits, strict=True)]
            yield batch.filter(pa.array(fits, pa.bool_())).select([0, 1])

    return cut_lineage(met.mapInArrow(bound, "a long, b long").distinct())


def _texts(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(sid, text) of the sets that pairs (a, b) ask for.

    Rows are joined by id and set: those without an id, or of one id, meet only their own set.
    """
    rows, wanted = _asked(_both(pairs), sets, docs)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = [shingler.set_of(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            sids = pa.array([set_id(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sids, batch.column(1)], ["key", "sid", "text"])

    return rows.mapInArrow(number, "key long, sid long, text string").join(wanted, ["key", "sid"]).select("sid", "text")


def overlaps(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, na, nb, inter) of the possible pairs (a, b), from the whole texts.

    The texts of the sets asked for are found by their documents' ids and the sets' numbers, and
    brought to the pairs. A set that many pairs ask for stays one row; its pairs are split by the
    adaptive skew join.
    """
    pairs = possible(pairs, sets, docs)
    texts = _texts(pairs, sets, docs)
    left = pairs.join(texts.withColumnsRenamed({"sid": "a", "text": "ta"}), "a")
    met = left.join(texts.withColumnsRenamed({"sid": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, near = Shingler(), {}
        for batch in batches:
            rows: list[tuple] = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for k in range(batch.num_rows):
                sa = shingler.set_of(ta[k].as_py() or b"")
                if b[k] not in near:
                    if len(near) > 16:
                        near.clear()
                    sb = shingler.set_of(tb[k].as_py() or b"")
                    near[b[k]] = sb if set_id(sb) == b[k] else None
                sb = near[b[k]]
                if sb is None:
                    del near[b[k]]
                elif set_id(sa) == a[k]:
                    inter = len(np.intersect1d(sa, sb, assume_unique=True))
                    rows.append((a[k], b[k], len(sa), len(sb), inter))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "na", "nb", "inter"])

    return cut_lineage(met.mapInArrow(compare, "a long, b long, na long, nb long, inter long").distinct())


def leaders(sets: DataFrame) -> DataFrame:
    """(a, b): each set with the most shared-with set that it shares a band key with, if not itself."""
    keys = sets.select("sid", F.explode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = cut_lineage(keys.join(shared, "key"))
    fame = held.groupBy("sid").agg(F.sum("c").alias("fame"))
    known = held.join(fame, "sid")
    first = known.groupBy("key").agg(F.max(F.struct("fame", F.col("sid").alias("lead"))).alias("top"))
    best = known.join(first, "key").groupBy("sid").agg(F.max("top").alias("top"))
    return best.select(F.col("sid").alias("a"), F.col("top.lead").alias("b")).where("a <> b")


def postings(scanned: DataFrame, members: DataFrame) -> DataFrame:
    """(h, sid, root, n, rest) of the first shingles of every set; rest counts those from there on.

    Only one row of each set (its smallest id) is indexed.
    """
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "sid", "root", "n", "rest"]
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            sizes = np.array([len(x) for x in firsts])
            sid, root, n = (np.repeat(batch.column(k).to_numpy(), sizes) for k in range(3))
            place = np.arange(len(sid)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            arrays = (np.concatenate(firsts), sid, root, n, n - place)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("key")
    chosen = members.select("sid", F.coalesce("rep", F.lit(NO_ID)).alias("key"), "root")
    held = scanned.where("n > 0").select(key, "sid", "n", "first").join(chosen, ["sid", "key"])
    return held.select("sid", "root", "n", "first").mapInArrow(entries, "h long, sid long, root long, n long, rest long")


def size_block(n: int) -> int:
    """Sizes that can link are in the same block or in neighbours: a block spans a factor above 1.25."""
    return bisect_right(BLOCKS, n)


BLOCKS = [1]
while BLOCKS[-1] < 1 << 50:
    BLOCKS.append(BLOCKS[-1] * 5 // 4 + 1)


def _needed(a: int, b: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def join_list(sid: np.ndarray, root: np.ndarray, n: np.ndarray, rest: np.ndarray, most_pairs: float = np.inf) -> set[tuple[int, int]] | None:
    """Pairs of sets whose entries in one list can belong to linked sets of different roots; None if they are too many.

    Entries stand in blocks of similar size, and in a block in order of what follows them, so that those which
    leave too few shingles are one skipped tail. The entries of the root that has most are never scanned
    for themselves: each entry of the other roots looks for its partners among all.
    """
    found: set[tuple[int, int]] = set()
    values, counts = np.unique(root, return_counts=True)
    most = values[counts.argmax()]
    place = np.array([size_block(x) for x in n.tolist()])
    blocks = {}
    for g in np.unique(place).tolist():
        rows = np.flatnonzero(place == g)
        blocks[g] = rows[np.argsort(-rest[rows], kind="stable")]
    for k in np.flatnonzero(root != most).tolist():
        size, r, own = int(n[k]), int(rest[k]), root[k]
        for g in (place[k] - 1, place[k], place[k] + 1):
            rows = blocks.get(int(g))
            if rows is None:
                continue
            least = _needed(size, max(int(n[rows].min()), -(-PERCENT * size // 100)))
            if r < least:
                continue  # the whole block asks for more than is left here
            rows = rows[:np.searchsorted(-rest[rows], -least, side="right")]  # and the tail leaves too few
            m = n[rows]
            needed = -(-PERCENT * (size + m) // (100 + PERCENT))
            fits = (root[rows] != own) & (np.minimum(rest[rows], r) >= needed) & (
                100 * np.minimum(m, size) >= PERCENT * np.maximum(m, size))
            for y in sid[rows[fits]].tolist():
                x = int(sid[k])
                found.add((x, y) if x < y else (y, x))
            if len(found) > most_pairs:
                return None
    return found


def meet(entries: DataFrame) -> DataFrame:
    """(a, b, h, root, rest): sets a < b of different roots that share an entry of the index and aren't ruled out by it.

    A crowded list h gives out its members a instead, with root and rest, without b.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        crowds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        held = [np.zeros(0, np.int64)] * 5

        def out() -> pa.RecordBatch:
            pairs = sorted(found)
            a = np.concatenate([np.array([p[0] for p in pairs], np.int64), *[c[1] for c in crowds]])
            b = pa.array([p[1] for p in pairs] + [None] * (len(a) - len(pairs)), pa.int64())
            h = pa.array([None] * len(pairs) + [c[0] for c in crowds for _ in range(len(c[1]))], pa.int64())
            root, rest = (pa.array([None] * len(pairs) + [x for c in crowds for x in c[k].tolist()], pa.int64()) for k in (2, 3))
            found.clear()
            crowds.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), b, h, root, rest], ["a", "b", "h", "root", "rest"])

        def lists(columns: list[np.ndarray]) -> None:
            h, sid, root, n, rest = columns
            if not len(h):
                return
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            starts, stops = cuts[:-1], cuts[1:]
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            mixed = changes[stops - 1] > changes[starts]  # entries are in order of (h, root)
            for a, b in zip(starts[mixed].tolist(), stops[mixed].tolist(), strict=True):
                pairs = join_list(sid[a:b], root[a:b], n[a:b], rest[a:b], CROWDED * (b - a))
                if pairs is None:
                    _, once = np.unique(sid[a:b], return_index=True)
                    crowds.append((int(h[a]), *[x[a:b][once] for x in (sid, root, rest)]))
                else:
                    found.update(pairs)

        for batch in batches:
            columns = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            last = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            lists([x[:last] for x in columns])
            held = [x[last:] for x in columns]
            if len(found) + sum(len(c[1]) for c in crowds) > 100_000:
                yield out()
        lists(held)
        yield out()

    parts = entries.repartition("h").sortWithinPartitions("h", "root")
    return parts.mapInArrow(run, "a long, b long, h long, root long, rest long")


def compare_tile(ids: list[int], roots: list[int], tiles: list[int], raw: list[bytes]) -> list[tuple[int, int]]:
    """Links that join members of different roots, between two tiles or within one: only those that join anew."""
    sets = [np.frombuffer(x, np.uint64) for x in raw]
    bits = [parity(s).tobytes() for s in sets]
    top = {r: r for r in roots}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    out, across = [], len(set(tiles)) > 1
    order = sorted(range(len(ids)), key=lambda k: len(sets[k]))
    for at, x in enumerate(order):
        for y in order[at + 1:]:
            m, n = len(sets[x]), len(sets[y])
            if 100 * m < PERCENT * n:
                break  # and those that follow are larger still
            if across and tiles[x] == tiles[y]:
                continue
            p, q = find(roots[x]), find(roots[y])
            if p == q or (m + n - apart(bits[x], bits[y])) // 2 < _needed(m, n):
                continue
            inter = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if _linked(inter, m, n):
                top[p] = q
                out.append((ids[x], ids[y]))
    return out


def partners(ids: list[int], roots: list[int], sizes: list[int], rests: list[int], befores: list[int], tiles: list[int],
             bits: list[bytes]) -> np.ndarray:
    """Places of the members, of two tiles or one, that have a partner of another root which nothing rules out.

    The first shingle that two sets share in the order is followed by all others, and different ones stand before it.
    """
    root, size, rest, before, tile = (np.array(x, np.int64) for x in (roots, sizes, rests, befores, tiles))
    order = np.argsort(size, kind="stable")
    root, size, rest, before, tile = (x[order] for x in (root, size, rest, before, tile))
    across, found = len(set(tiles)) > 1, np.zeros(len(order), bool)
    for x in range(len(order)):
        m = int(size[x])
        near = slice(x + 1, int(np.searchsorted(size, 100 * m // PERCENT, side="right")))
        needed = -(-PERCENT * (m + size[near]) // (100 + PERCENT))
        fits = (root[near] != root[x]) & (before[near] != before[x]) & (np.minimum(rest[near], rest[x]) >= needed)
        if across:
            fits &= tile[near] != tile[x]
        for y in (np.flatnonzero(fits) + x + 1).tolist():
            if found[x] and found[y]:
                continue
            n = int(size[y])
            if (m + n - apart(bits[order[x]], bits[order[y]])) // 2 >= _needed(m, n):
                found[x] = found[y] = True
    return order[found]


def _tiles(table: pa.Table) -> pa.Table:
    """Members of one list with their block, tile, and the blocks that a block meets with their numbers of tiles.

    A block holds sizes of one size block, and either members with the shingle before that most have, or the others. The
    former needn't meet each other.
    """
    before = table.column("before").to_numpy()
    values, counts = np.unique(before, return_counts=True)
    block = np.array([2 * size_block(n) for n in table.column("n").to_pylist()]) + (before == values[counts.argmax()])
    tile, parts = np.zeros(len(block), np.int64), {}
    for g in np.unique(block).tolist():
        rows = np.flatnonzero(block == g)
        parts[g] = -(-len(rows) // TILE)
        tile[rows] = np.arange(len(rows)) % parts[g]
    ways = {g: [{"other": o, "parts": parts[o]} for o in ((g - 3, g - 1, g + 1) if g % 2 else range(g - 2, g + 4)) if o in parts] for g in parts}
    kind = pa.list_(pa.struct([("other", pa.int64()), ("parts", pa.int64())]))
    return table.append_column("block", pa.array(block)).append_column("tile", pa.array(tile)).append_column(
        "ways", pa.array([ways[g] for g in block.tolist()], kind))


def crowded_links(crowds: DataFrame, sets: DataFrame, docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Edges (u, v) among the members (h, sid, root, rest) of crowded lists.

    A set stands once in a table of whole sets, bitmaps and first shingles, of which only bitmaps go to all tiles.
    """
    rows, wanted = _asked(crowds.select("sid").distinct(), sets, docs)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = [shingler.set_of(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_id(s) if len(s) else None for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                 *[pa.array([f(s) for s in found], pa.binary()) for f in (lambda s: first_of(s, order), lambda s: parity(s).tobytes(), np.ndarray.tobytes)]],
                ["key", "sid", "n", "first", "bits", "s"])

    whole = written(rows.mapInArrow(number, "key long, sid long, n long, first binary, bits binary, s binary").join(
        wanted, ["key", "sid"]).drop("key").dropDuplicates(["sid"]), "jaccard-crowds")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands before each of a set's lists, the set's own number if it's the first."""
        for batch in batches:
            out: list[tuple] = []
            for sid, n, first, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shingles = np.frombuffer(first, np.int64).tolist()
                before = dict(zip(shingles, [sid, *shingles], strict=False))
                out += [(x["h"], sid, x["root"], n, x["rest"], before[x["h"]]) for x in held]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "sid", "root", "n", "rest", "before"])

    lists = crowds.groupBy("sid").agg(F.collect_list(F.struct("h", "root", "rest")).alias("held"))  # a set's first shingles at most
    entry = "h long, sid long, root long, n long, rest long, before long"
    placed = whole.select("sid", "n", "first").join(lists, "sid").mapInArrow(place, entry).groupBy("h").applyInArrow(
        _tiles, f"{entry}, block long, tile long, ways array<struct<other: long, parts: long>>")
    met = placed.select("h", "sid", "root", "n", "rest", "before", "block", "tile", F.inline("ways")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    same, first = F.col("block") == F.col("other"), F.col("block") < F.col("other")
    at = ["h", "low", "high", "i", "j"]
    met = met.select("h", "sid", "root", "n", "rest", "before", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     F.when(same, F.least("tile", "q")).when(first, F.col("tile")).otherwise(F.col("q")).alias("i"),
                     F.when(same, F.greatest("tile", "q")).when(first, F.col("q")).otherwise(F.col("tile")).alias("j"),
                     (F.shiftleft("block", 40) + F.col("tile")).alias("tile"))
    bitmaps = met.join(whole.select("sid", "bits"), "sid").select(*at, "sid", "root", "n", "rest", "before", "tile", "bits")

    def some(table: pa.Table) -> pa.Table:
        found = partners(*[table.column(c).to_pylist() for c in ("sid", "root", "n", "rest", "before", "tile", "bits")])
        return table.select([*at, "sid", "root", "tile"]).take(pa.array(found))

    left = cut_lineage(bitmaps.groupBy(*at).applyInArrow(some, ", ".join(f"{c} long" for c in (*at, "sid", "root", "tile"))))

    def run(table: pa.Table) -> pa.Table:
        found = compare_tile(*[table.column(c).to_pylist() for c in ("sid", "root", "tile", "s")])
        return pa.table({"u": pa.array([p[0] for p in found], pa.int64()), "v": pa.array([p[1] for p in found], pa.int64())})

    return left.join(whole.select("sid", "s"), "sid").select(*at, "sid", "root", "tile", "s").groupBy(*at).applyInArrow(run, "u long, v long")


LINKED = f"100 * inter >= {PERCENT} * (na + nb - inter)"


def _stars(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """(sid, rep, n, lead, more, less): each set's star, its shingles that the leader lacks, and the reverse.

    A set that leads others leads its own star, whatever it links to.
    """
    centres = linked.select(F.col("b").alias("a")).distinct()
    joined = linked.join(centres, "a", "left_anti").select(F.col("a").alias("sid"), "b", "nb", "inter")
    own = sets.select("sid", "rep", "n").join(joined, "sid", "left")
    return own.select("sid", "rep", "n", F.coalesce("b", "sid").alias("lead"),
                      (F.col("n") - F.coalesce("inter", "n")).alias("more"),
                      (F.coalesce("nb", "n") - F.coalesce("inter", "n")).alias("less"))


def _edges(found: DataFrame) -> DataFrame:
    return found.where(LINKED).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _derive(cands: DataFrame, members: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among candidate pairs of sets, as edges.

    First the pairs' leaders P and Q are compared. As x and P differ by ``more`` and ``less`` shingles, the
    overlap of x and y lies between overlap(P, Q) - less(x) - less(y) and overlap(P, Q) + more(x) + more(y).
    Only pairs that this leaves open are compared themselves.
    """
    of = lambda c: members.select(F.col("sid").alias(c), F.col("lead").alias(f"lead_{c}"),
                                  *[F.col(k).alias(f"{k}_{c}") for k in ("n", "more", "less")])
    pairs = cut_lineage(cands.join(of("a"), "a").join(of("b"), "b"))
    p, q = F.least("lead_a", "lead_b"), F.greatest("lead_a", "lead_b")
    pairs = pairs.withColumns({"p": p, "q": q})
    met = overlaps(pairs.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")), sets, docs)
    known = met.select(F.col("a").alias("p"), F.col("b").alias("q"), "inter")
    held = pairs.join(known, ["p", "q"], "left")
    needed = F.ceil(F.lit(PERCENT) * (F.col("n_a") + F.col("n_b")) / float(100 + PERCENT) - 1e-9)
    surely = F.col("inter") - F.col("less_a") - F.col("less_b") >= needed
    hardly = F.col("inter") + F.col("more_a") + F.col("more_b") < needed
    derived = held.where(F.coalesce(surely, F.lit(False)))
    own = (F.col("a") != F.col("lead_a")) | (F.col("b") != F.col("lead_b"))
    left = held.where(own & ~F.coalesce(surely | hardly, F.lit(False))).select("a", "b")
    return _edges(met).unionByName(derived.select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(
        _edges(overlaps(left, sets, docs)))


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and (sid, rep, n, root) of every set."""
    ship(rows.sparkSession)
    order = frequent_shingles(rows, rows.count())
    scanned = written(scan(rows, order), "jaccard-scan")
    sets = cut_lineage(scanned.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), *[F.max(f"b{b}").alias(f"b{b}") for b in range(BANDS)]))
    release_done(rows.sparkSession)
    first = overlaps(leaders(sets), sets, rows)
    stars = _stars(sets, first.where(LINKED))
    roots = components(_edges(first))
    members = cut_lineage(stars.join(roots, F.col("sid") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "sid")).drop("node"))
    release_done(rows.sparkSession)
    found = cut_lineage(meet(postings(scanned, members)))
    release_done(rows.sparkSession)  # the index is the largest shuffle
    cands = found.where("b IS NOT NULL").select("a", "b").distinct()
    edges = _edges(first).unionByName(_derive(cands, members, sets, rows))
    crowds = found.where("b IS NULL").select("h", F.col("a").alias("sid"), "root", "rest")
    if not crowds.isEmpty():
        edges = edges.unionByName(crowded_links(crowds, sets, rows, order))
    roots = components(edges)
    labelled = sets.select("sid", "rep", "n").join(roots, F.col("sid") == F.col("node"), "left")
    return scanned, cut_lineage(labelled.select("sid", "rep", "n", F.coalesce("root", "sid").alias("root")))


def jaccard_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    scanned, labelled = set_components(_rows(docs, text_col, id_col))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = labelled.join(smallest, "root").select("sid", "component_id")
    found = scanned.select("doc_id", "sid", F.col("n").alias("n_shingles")).join(of_set, "sid", "left")
    return found.select("doc_id", "n_shingles",
                        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, all columns: of each component the row with the smallest id; rows without shingles stay.

    Rows of an id that stands there once are decided by it. Rows without an id or with a repeated one are matched by
    (id, set), of which a component holds many, so no key is hot; of repeated rows one stays.
    """
    names = docs.columns
    scanned, labelled = set_components(_rows(docs, text_col, id_col))
    keys = labelled.withColumn("key", F.coalesce("rep", F.lit(NO_ID))).groupBy("root").agg(F.min(F.struct("key", "sid")).alias("k"))
    kept = keys.select("k.key", "k.sid", F.lit(True).alias("kept"))
    seen = scanned.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "sid").join(kept, ["key", "sid"], "left")
    stays = F.col("sid").isNull() | F.coalesce("kept", F.lit(False))
    by_id = seen.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.max(stays).alias("stays"))
    # ids whose rows don't simply stay: to drop, or to be looked at row by row
    other = by_id.where("times > 1 OR NOT stays").select("key", (F.col("times") > 1).alias("repeated"))

    def number(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler()
        for texts in frames:
            sets = [shingler.set_of(b"" if pd.isna(t) else t.encode()) for t in texts]
            yield pd.Series([set_id(s) if len(s) else None for s in sets], dtype="Int64")

    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("key")
    met = cut_lineage(other)
    held = _marked(docs.select(F.struct(*[docs[c] for c in names]).alias("row"), key), met)
    doubtful = held.where("marked").select("row", "key")   # only these rows move
    single = held.where("NOT marked").select("row.*").unionByName(doubtful.join(met, "key", "left_anti").select("row.*"))
    repeated = doubtful.join(met.where("repeated").select("key"), "key", "left_semi").withColumn(
        "sid", F.pandas_udf(number, "long")(F.col("row").getField(text_col)))
    blank = repeated.where("sid IS NULL").select("row.*")
    nth = F.row_number().over(Window.partitionBy("key", "sid").orderBy("key"))
    first = repeated.where("sid IS NOT NULL").join(kept, ["key", "sid"], "left_semi").withColumn("nth", nth).where("nth = 1")
    return single.unionByName(first.select("row.*")).unionByName(blank)
