"""Operator 11, quality by Bradley-Terry ranking of pairs.

A document has a worth z = w . features(text), and of two documents the first is the better one with
probability sigmoid(z1 - z2). The weights are learned from preference pairs, each a document labelled good
against one labelled bad, by the logistic loss on the difference of their features, in numpy.

1. **Pairs.** At most ``per_label`` documents of each label, chosen by a hash of their ids among the learning
   folds, and ``pairs_each`` partners for each of them, drawn with a fixed seed. These are the only bounds.
2. **Features.** What a text is made of, not what it says: shares of neighbouring byte classes (letters,
   capitals, digits, marks ...), of repeated words, lines and three-word windows, of capital words, lengths.
   Shares have a constant added below, so that short texts don't go to extremes.
3. **Threshold.** Every whole text gets its z. The threshold is the quantile of z over *all* labelled documents
   of the learning folds, at their share of bad ones: counts of z by bins, summed up by Spark. A score is
   sigmoid(z - threshold), moved so that a document at the threshold has ``cut``.

Defined results: null, empty and blank texts get the score of a text without words; without labels of
both kinds in the learning folds every score is 1, 0 or (no labels) 0.5; labels that are neither 0 nor 1 or have
no id are ignored; a document labelled twice is bad if one label says so; a null id counts as empty
text in the hash and has no label; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, ship
from rankweave.llm.language_id import held_out

PER_LABEL, PAIRS_EACH = 1_500, 16
CUT = 0.7
SPREAD = 24              # texts count as this many bytes or words longer in shares
BIN = 1 / 256            # width of the bins of z
LARGEST_Z = 200.0

# fixed values: classes of bytes; all other ASCII signs are one class, control characters and non-ASCII bytes another each
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",", "!?",
           "|", "#*$%&<>", "()[]{}\"'")
N_CLASSES = len(CLASSES) + 3
CLASS_OF = np.full(256, len(CLASSES), dtype=np.int64)
CLASS_OF[:32] = len(CLASSES) + 1
CLASS_OF[128:] = len(CLASSES) + 2
for _k, _signs in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_signs.encode(), dtype=np.uint8)] = _k
N_FEATURES = N_CLASSES * N_CLASSES + 9


def _repeated(found: list) -> int:
    """How many of these have occurred before."""
    return len(found) - len(set(found))


def features(text: str | None) -> np.ndarray:
    """N_FEATURES numbers of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    kind = CLASS_OF[np.frombuffer(raw, dtype=np.uint8)]
    pairs = np.bincount(kind[:-1] * N_CLASSES + kind[1:], minlength=N_CLASSES * N_CLASSES)
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n)
    most = max(Counter(words).values(), default=0)
    shares = [sum(a == b for a, b in zip(words, words[1:], strict=False)), _repeated(windows),
              sum(w.isupper() and len(w) > 1 for w in raw.split()), most, _repeated(words) * (n > 2 * SPREAD)]
    more = [x / (n + SPREAD) for x in shares] + [
        _repeated(lines) / (len(lines) + 4), math.log1p(n), float(sizes.mean()) if n else 0.0, float(sizes.std()) if n else 0.0]
    return np.concatenate([np.sqrt(pairs / (len(raw) + SPREAD)), more]).astype(np.float32)


class Model(NamedTuple):
    """z of features x is (x - mean) / deviation . weights, and so ``offset`` + x . ``slope``."""
    slope: np.ndarray
    offset: float

    def worth(self, texts: list[str | None]) -> list[float]:
        z = [float(features(t) @ self.slope) + self.offset for t in texts]
        return np.clip(z, -LARGEST_Z, LARGEST_Z).tolist()


def preference_pairs(n_good: int, n_bad: int, each: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) places of the pairs: each document takes part in ``each`` of them at least."""
    rng = np.random.default_rng(seed)
    good, bad = np.repeat(np.arange(n_good), each), np.repeat(np.arange(n_bad), each)
    return (np.concatenate([good, rng.integers(0, n_good, len(bad))]),
            np.concatenate([rng.integers(0, n_bad, len(good)), bad]))


def fit(good: np.ndarray, bad: np.ndarray, each: int = PAIRS_EACH, steps: int = 400, rate: float = 0.02,
        decay: float = 2e-3) -> Model:
    """Weights that minimise the mean of log(1 + exp(-(z_good - z_bad))) over the pairs, by Adam."""
    both = np.concatenate([good, bad]).astype(np.float64)
    mean, deviation = both.mean(axis=0), both.std(axis=0)
    x = (both - mean) / np.where(deviation > 1e-9, deviation, np.inf)
    i, j = preference_pairs(len(good), len(bad), each)
    j = j + len(good)
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        wrong = 1 / (1 + np.exp(np.clip(z[i] - z[j], -40, 40)))   # probability of the other order
        pull = np.bincount(i, wrong, len(x)) - np.bincount(j, wrong, len(x))
        g = -(pull @ x) / len(i) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    slope = w / np.where(deviation > 1e-9, deviation, np.inf)
    return Model(slope, -float(mean @ slope))


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of the learning folds, one row for each document."""
    return labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 4, 2)).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))


def train(rows: DataFrame, known: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Fit on rows (doc_id, text); None without documents of both labels."""
    order = F.xxhash64(F.lit(11), "id")
    lists = [known.where(F.col("y") == y).orderBy(order, "id").limit(per_label) for y in (0, 1)]
    ids = F.broadcast(lists[0].unionByName(lists[1]))  # at most 2 * per_label rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "y": f["y"], "x": [features(None if pd.isna(t) else t).tobytes() for t in f["text"]]})

    chosen = rows.select(F.col("doc_id").alias("id"), "text").join(ids, "id").select("id", "y", "text")
    # the limit only matters where many rows share one id
    found = chosen.mapInPandas(run, "id long, y int, x binary").limit(4 * per_label).toPandas().sort_values(["id", "x"])
    good, bad = (np.array([np.frombuffer(x, np.float32) for x in found["x"][found["y"] == y]]) for y in (1, 0))
    return fit(good, bad) if len(good) and len(bad) else None


def quantile_threshold(judged: DataFrame) -> float:
    """z below which the share of rows (z, y) equals the share of bad ones, to a bin's width.

    The threshold is in the middle between the last bin below and the first one above that hold rows.
    """
    found = judged.groupBy(F.floor(F.col("z") / BIN).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("bad")).orderBy("bin").collect()  # 2 LARGEST_Z / BIN bins at most
    wanted, seen = sum(r["bad"] for r in found), 0
    for k, r in enumerate(found):
        if seen + r["n"] / 2 > wanted:  # the nearer end of the bin that the quantile falls into
            below = found[k - 1]["bin"] + 1 if k else r["bin"]
            return (below + r["bin"]) * BIN / 2
        seen += r["n"]
    return (found[-1]["bin"] + 1) * BIN


def quality_ranking(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    label_col: str = "quality", per_label: int = PER_LABEL, cut: float = CUT) -> DataFrame:
    """Score of every document."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = cut_lineage(known_labels(labels, id_col, label_col))
    model = train(rows, known, per_label)
    fold = held_out(F.col("doc_id"), 4, 2).alias("held_out")
    if model is None:
        share = known.agg(F.avg("y").alias("p")).first()["p"]
        score = 0.5 if share is None else float(share > 0.5)
        return rows.select("doc_id", fold, F.lit(score).alias("score"), F.lit(int(score >= cut)).alias("predicted"))
    sent = spark.sparkContext.broadcast(model)  # N_FEATURES numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [None if pd.isna(t) else t for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "z": np.array(sent.value.worth(texts), dtype=float)})

    scored = cut_lineage(rows.mapInPandas(run, "doc_id long, z double"))
    at = quantile_threshold(scored.join(known, F.col("doc_id") == F.col("id")).select("z", "y"))
    score = 1 / (1 + F.exp(-(F.col("z") - F.lit(at) + F.lit(math.log(cut / (1 - cut))))))
    return scored.select("doc_id", fold, score.alias("score"), (score >= cut).cast("int").alias("predicted"))
