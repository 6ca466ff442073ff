"""Operator 2, toxicity by non-negative positive-unlabelled learning.

Only toxic examples are confirmed; all other documents are a mixture of unknown shares. With the
class prior, the risk of calling something clean can be estimated from unlabelled and toxic
texts alone, and it is kept from going below zero, where a flexible model would overfit:

    R = prior * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_toxic[loss(-)])

The classifier is linear over hashed character n-grams of words (marks at the word's ends), each
counted per word of the document and scaled by how much more of the toxic sample than of the
unlabelled one holds it. It is fitted in numpy on a sample: at most ``positives`` toxic
and ``unlabelled`` other documents of the learning folds, chosen by a hash of their ids. The
prior is the share of toxic labels in the learning folds. Being linear, it gives each word one
number, and scoring a whole text adds up its words' numbers.

Defined results: null and empty text get the score of a text without words; without toxic examples
every text gets score 0; a null id counts as empty text in the hash, which holds it out, and has no label;
labels that are neither 0 nor 1 are ignored; a document labelled twice is toxic if one label says so; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import ship
from rankweave.llm.language_id import held_out

POSITIVES, UNLABELLED = 1_000, 3_000
MIN_TOXIC_TEXTS = 5  # that an n-gram must occur in; fewer where there are under 100
BUCKETS, SIZES, SCALE = 1 << 18, (4, 5, 6), 40.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.uint32)


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of the word) of every n-gram of these words, each with a mark at either end, and of
    the words themselves. All words are hashed together, as polynomials over one array of bytes."""
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    sizes = np.array([len(w) + 2 for w in found])
    raw = np.frombuffer(b"<" + b"><".join(found) + b">", dtype=np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(len(raw)) - first[word]
    left = sizes[word] - place
    powers = np.cumprod(np.full(max(int(sizes.max()), *SIZES), MULTIPLIER), dtype=np.uint64)
    buckets, words_of = [_bucket(np.add.reduceat(raw * powers[place], first))], [np.arange(len(found))]
    h = raw * powers[0]
    for n in range(2, max(SIZES) + 1):
        h = h[:len(raw) - n + 1] + raw[n - 1:] * powers[n - 1]
        if n in SIZES:
            inside = np.flatnonzero(left[:len(h)] >= n)
            buckets.append(_bucket(h[inside] + np.uint64(n)))
            words_of.append(word[inside])
    return np.concatenate(buckets), np.concatenate(words_of)


def words(text: str | None) -> list[bytes]:
    return WORDS.findall(text.lower().encode()) if text else []


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: occurrences per word, times SCALE."""
    found = Counter(words(text))
    bucket, word = grams(list(found))
    times = np.fromiter(found.values(), dtype=np.float64, count=len(found))
    index, at = np.unique(bucket, return_inverse=True)
    value = np.bincount(at, times[word], len(index)) * (SCALE / max(1, sum(found.values())))
    return index, value.astype(np.float32)


def shares(rows: list[np.ndarray]) -> np.ndarray:
    """Number of texts that hold each bucket."""
    n = np.zeros(BUCKETS)
    for index in rows:
        n[index] += 1
    return n


def frequent(toxic: list[np.ndarray]) -> np.ndarray:
    """Which buckets enough toxic texts hold for a classifier to rely on."""
    return shares(toxic) >= max(2, min(MIN_TOXIC_TEXTS, len(toxic) // 20))


def emphasis(toxic: list[np.ndarray], mixed: list[np.ndarray]) -> np.ndarray:
    """Factor of each bucket: the squared log of how much larger its share of toxic texts is.

    Buckets that few toxic texts hold, or that are no more frequent among them, get 0.
    """
    p, u = shares(toxic), shares(mixed)
    ratio = np.log((p + 1) / (len(toxic) + 2)) - np.log((u + 1) / (len(mixed) + 2))
    return (np.maximum(ratio, 0) ** 2 * frequent(toxic)).astype(np.float32)


class Rows:
    """Sparse rows of so many columns, one after the other."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], columns: int = BUCKETS):
        self.columns = columns
        sizes = [len(i) for i, _ in rows]
        self.n = len(rows)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.uint32)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], self.n)

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * d[self.row].astype(np.float32), self.columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: Rows, unlabelled: Rows, prior: float, steps: int = 120, rate: float = 0.05, decay: float = 1e-3):
    """Weights and bias that minimise the non-negative risk under the logistic loss, by Adam."""
    w = np.zeros(positive.columns, dtype=np.float32)
    b = float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = positive.dot(w) + b, unlabelled.dot(w) + b
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        toxic_p = -prior * sigmoid(-zp) / positive.n  # derivative of prior * E[loss(+)]
        clean_p, clean_u = -prior * sigmoid(zp) / positive.n, sigmoid(zu) / unlabelled.n
        if clean >= 0:
            dp, du = toxic_p + clean_p, clean_u
        else:  # the estimate went below zero: step back along it
            dp, du = -clean_p, -clean_u
        g = (positive.back(dp) + unlabelled.back(du)).astype(np.float32) + decay * w
        gb = float(dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w, b


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """(weights, bias), or None without toxic examples. Only the learning folds are read."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()
                         & ~held_out(F.col(id_col), 5, 0)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    share = known.agg(F.avg("y").alias("p"), F.sum("y").alias("n")).first()
    if not share["n"]:
        return None
    order = F.xxhash64(F.lit(3), "id")
    # a bounded list of ids: the toxic sample
    ids = known.where("y = 1").select("id").distinct().orderBy(order, "id").limit(positives)
    rows = docs.where(~held_out(F.col(id_col), 5, 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    toxic = rows.join(F.broadcast(ids), "id")
    n = rows.count()
    draw = F.pmod(order, F.lit(1 << 24)) / float(1 << 24)
    mixed = rows.where(draw < min(1.0, unlabelled / max(n, 1)))

    def gather(part: DataFrame, used: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                pairs = [features(None if pd.isna(t) else t) for t in frame["text"]]
                if used is not None:
                    pairs = [(i[used[i]], v[used[i]]) for i, v in pairs]
                yield pd.DataFrame({"id": frame["id"].astype("Int64"), "i": [p[0].tobytes() for p in pairs],
                                    "v": [p[1].tobytes() for p in pairs]})

        # the limit only matters where many rows share one id
        got = part.mapInPandas(featured, "id long, i binary, v binary").limit(2 * max(positives, unlabelled)).toPandas().sort_values("id", kind="stable")
        return [(np.frombuffer(i, np.uint32), np.frombuffer(v, np.float32)) for i, v in zip(got["i"], got["v"], strict=True)]

    p = gather(toxic)
    # the other sample only brings the buckets that the toxic one can tell something about
    u = gather(mixed, frequent([i for i, _ in p])) if p else []
    if not p or not u:
        return None
    factor = emphasis([i for i, _ in p], [i for i, _ in u])

    used = np.flatnonzero(factor)
    column = np.zeros(BUCKETS, np.int64)
    column[used] = np.arange(len(used))

    def scaled(found: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        held = [(i[factor[i] > 0], v[factor[i] > 0]) for i, v in found]
        return Rows([(column[i], v * factor[i]) for i, v in held], len(used))

    w, bias = fit(scaled(p), scaled(u), min(max(float(share["p"]), 1e-3), 0.9))
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w * factor[used]
    return weights, bias


class Scorer:
    """Adds up words' numbers; those of words seen before are remembered, up to a bound."""

    def __init__(self, model, remember: int = 300_000):
        self.weights, self.bias = model
        self.remember, self.known = remember, {}

    def learn(self, found: list[list[bytes]]) -> None:
        """Numbers of the words that are new, all at once."""
        if len(self.known) > self.remember:
            self.known.clear()
        new = list({w for ws in found for w in ws if w not in self.known})
        bucket, word = grams(new)
        self.known.update(zip(new, np.bincount(word, self.weights[bucket], len(new)).tolist(), strict=True))

    def scores(self, texts: list[str | None], lot: int = 200) -> list[float]:
        z = []
        for a in range(0, len(texts), lot):
            found = [words(t) for t in texts[a:a + lot]]
            self.learn(found)
            known = self.known
            z += [self.bias + sum([known[w] for w in ws]) * (SCALE / max(1, len(ws))) for ws in found]
        return sigmoid(np.array(z)).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Score of every document."""
    spark = docs.sparkSession
    ship(spark)
    model = train(docs, labels, text_col, id_col, label_col, positives, unlabelled)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS floats

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value) if sent.value is not None else None
        for frame in frames:
            texts = [None if pd.isna(t) else t for t in frame["text"]]
            scores = scorer.scores(texts) if scorer else [0.0] * len(texts)
            yield frame.drop(columns="text").assign(doc_id=frame["doc_id"].astype("Int64"), score=scores,
                                                    predicted=[int(s >= 0.5) for s in scores])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 5, 0).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA)
