"""Operator 3, LM scoring by cross-entropy difference.

Two n-gram models over characters, one of the target texts and one of all texts (the background), have
the same order, smoothing and vocabulary: the characters of all texts. A document's score is the mean
over its characters of the difference of the two losses, -log p_target + log p_background: the lower, the
more like the target it is. Lower orders are interpolated, each with an additive constant.

All texts are counted, and nothing is pruned. Documents are dealt to blocks of about ``BLOCK_CHARS``
characters by a hash of their id and text. A block is counted on its own and gives one row for each n-gram it
holds; Spark sums these over the corpus, and sends each block the sums of just its own n-grams. So a task
holds one block of texts and the n-grams that occur in it, however large the corpus and its model are. An
n-gram of a third of all rows is one row per block, and its rows are split by the adaptive skew join.

Defined results: null and empty texts have no characters: n_chars 0 and scores null; without target
texts the target model knows only the vocabulary; rows without an id are background; repeated rows
count as often as they occur and score alike; labels of unknown ids are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, ship

ORDER = 3
BLOCK_CHARS = 16_000_000
SMOOTH = 0.5
PIECE = 1_000_000  # characters that are worked on at a time
COUNTS = "block long, gram long, history long, level int, total long, target long"
SCORES = "doc_id long, n_chars long, target_loss double, background_loss double, score double"
START = 0x110000  # stands before the first character
DENSE = 1 << 22  # tables of up to so many codes are arrays, larger ones are sorted


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(points: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of sequences of code points, given as one array for each place."""
    k = np.full(len(points[0]), len(points), np.uint64) if points else np.zeros(0, np.uint64)
    for p in points:
        k = _hash(k * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64) + np.uint64(1))
    return k.view(np.int64)


class Lot:
    """Texts end to end, with START before each, and their n-grams in the lot's own alphabet.

    The code of an n-gram has its last character as its lowest digit, so the remainder by a power of the
    alphabet's size is the code of its last characters.
    """

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        at = np.arange(len(points)) + (ORDER - 1) * np.repeat(np.arange(1, len(texts) + 1), self.sizes)
        padded = np.full(len(points) + (ORDER - 1) * len(texts), START, dtype=np.uint32)
        padded[at] = points
        seen = np.zeros(START + 1, bool)
        seen[padded] = True
        self.alphabet = np.flatnonzero(seen)
        place = np.zeros(START + 1, np.int64)
        place[self.alphabet] = np.arange(len(self.alphabet))
        digits = place[padded]
        size = len(self.alphabet)
        self.powers = [size ** n for n in range(ORDER + 1)]
        code = np.zeros(len(at), np.int64)
        self.codes, self.distinct = [], []
        for n in range(ORDER):
            code = code + digits[at - n] * self.powers[n]
            self.codes.append(code)
            if self.powers[n + 1] <= DENSE:
                held = np.zeros(self.powers[n + 1], bool)
                held[code] = True
                self.distinct.append(np.flatnonzero(held))
            else:
                self.distinct.append(np.unique(code))

    def index(self, n: int, codes: np.ndarray | None = None) -> np.ndarray:
        """Place among the distinct n-grams of these codes, or of each character's."""
        codes = self.codes[n - 1] if codes is None else codes
        if self.powers[n] <= DENSE:
            place = np.zeros(self.powers[n], np.int32)
            place[self.distinct[n - 1]] = np.arange(len(self.distinct[n - 1]))
            return place[codes]
        return np.searchsorted(self.distinct[n - 1], codes)

    def key(self, n: int, history: bool = False) -> np.ndarray:
        """Keys of the distinct n-grams, or of what stands before their last characters."""
        u = self.distinct[n - 1]
        digits = [self.alphabet[u // self.powers[k] % self.powers[1]] for k in range(n - 1, -1, -1)]
        if history and n == 1:
            return np.zeros(len(u), np.int64)
        return key_of(digits[:-1] if history else digits)


def _lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE characters."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


def count_block(key, texts: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """Counts of a block's n-grams, in all of its texts and in the target's."""
    wanted = set(targets["doc_id"])
    marks = np.array([not pd.isna(x) and x in wanted for x in texts["doc_id"]], dtype=bool)
    found, bodies = [], texts["text"].tolist()
    for a, b in _lots(bodies):
        lot = Lot(bodies[a:b])
        flag = np.repeat(marks[a:b], lot.sizes)
        for n in range(1, ORDER + 1):
            index, m = lot.index(n), len(lot.distinct[n - 1])
            found.append(pd.DataFrame({"gram": lot.key(n), "history": lot.key(n, True), "level": n,
                                       "total": np.bincount(index, minlength=m),
                                       "target": np.bincount(index[flag], minlength=m)}))
        if len(found) >= 24 * ORDER:
            found = [pd.concat(found).groupby(["gram", "history", "level"], as_index=False).sum()]
    names = [x.split()[0] for x in COUNTS.split(", ")]
    if not found:
        return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
    out = pd.concat(found).groupby(["gram", "history", "level"], as_index=False).sum()
    return out.assign(block=key[0])[names]


def _scorer(vocabulary: int):
    weight = SMOOTH * vocabulary

    def run(key, texts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for n in range(1, ORDER + 1):
            part = model[model["level"] == n].sort_values("gram")
            tables.append((part["gram"].to_numpy(), part[["total", "target", "h_total", "h_target"]].to_numpy(np.float64).T))
        found, bodies = [], texts["text"].tolist()
        for a, b in _lots(bodies):
            lot = Lot(bodies[a:b])
            p_all = p_target = np.full(1, 1.0 / vocabulary)
            for n in range(1, ORDER + 1):
                known, numbers = tables[n - 1]
                total, target, h_total, h_target = numbers[:, np.searchsorted(known, lot.key(n))]
                shorter = 0 if n == 1 else lot.index(n - 1, lot.distinct[n - 1] % lot.powers[n - 1])
                p_all = (total + weight * p_all[shorter]) / (h_total + weight)
                p_target = (target + weight * p_target[shorter]) / (h_target + weight)
            index = lot.index(ORDER)
            first = np.cumsum(lot.sizes) - lot.sizes
            mean = lambda p: np.add.reduceat(-np.log(p)[index], first) / lot.sizes
            found.append(pd.DataFrame({"n_chars": lot.sizes, "target_loss": mean(p_target), "background_loss": mean(p_all)}))
        names = [x.split()[0] for x in SCORES.split(", ")]
        if not found:
            return pd.DataFrame({n: pd.Series(dtype="float64") for n in names})
        out = pd.concat(found, ignore_index=True)
        out["doc_id"] = texts["doc_id"].astype("Int64").to_numpy()
        out["score"] = out["target_loss"] - out["background_loss"]
        return out[names].astype({"doc_id": "Int64"})

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Losses and score of every document; ``targets`` holds the ids (doc_id) of the target texts."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_chars))
    # by id and text, so that rows without an id, or of one id, are dealt like others
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    dealt = rows.where("text <> ''").select(block, "doc_id", "text")
    full = dealt.repartition(blocks, "block")
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    # the target ids of every block: an id is one row in each block that holds it
    wanted = dealt.select("block", "doc_id").distinct().join(ids, "doc_id").select(
        *[F.col(c).alias(c) for c in ("block", "doc_id")]).repartition(blocks, "block")  # columns of their own for the cogroup
    counts = cut_lineage(full.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(count_block, COUNTS)
                         if size else spark.createDataFrame([], COUNTS))
    sums = cut_lineage(counts.groupBy("gram", "history", "level").agg(F.sum("total").alias("total"), F.sum("target").alias("target")))
    stats = sums.where("level = 1").agg(F.count(F.lit(1)).alias("v")).first()
    empty = rows.where("text = ''").select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[
        F.lit(None).cast("double").alias(c) for c in ("target_loss", "background_loss", "score")])
    if not stats["v"]:
        return empty
    before = sums.groupBy("history", "level").agg(F.sum("total").alias("h_total"), F.sum("target").alias("h_target"))
    model = sums.join(before, ["history", "level"])
    asked = counts.select("block", "gram", "level").join(model.drop("history"), ["gram", "level"]).repartition(blocks, "block")
    score = _scorer(stats["v"])
    return full.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(score, SCORES).unionByName(empty)
