"""Operator 8, language identification by a byte convolutional network.

Texts are taken in lower case. The network (``byte_cnn``) learns from a sample: about ``per_language`` labelled documents of each
language, chosen by a hash of their ids among those outside the held-out third, and up to
``PIECES`` stretches from anywhere in each. That is the only bound; every whole text is then cut
into windows of a fixed number of bytes, all windows are scored in batches, and a text's classes
get the mean of its windows' log-probabilities, weighted by their bytes.

Defined results: ``und`` with score 0 for a null text and one without a letter, and for every
text when there is nothing to learn from; a null id counts as empty text in the hash and isn't
held out; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.byte_cnn import WINDOW, ByteCNN, windows_of
from rankweave.llm.common import ship

PER_LANGUAGE, PIECES, EPOCHS = 600, 4, 4
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int) -> pd.DataFrame:
    """At most about ``per_language`` documents of each language, as stretches of text: (lang, piece)."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "piece": []})
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 24)) / float(1 << 24)
    chosen = rows.where(draw < share[F.col("lang")])
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda k: F.substring(
        F.col("text"), (F.pmod(F.xxhash64(k, F.col("id")), room) + 1).cast("int"), F.lit(WINDOW)))
    found = chosen.select("lang", "id", F.explode(F.array_distinct(pieces)).alias("piece"))
    return found.limit(2 * PIECES * per_language * len(counts)).toPandas().sort_values(["lang", "id", "piece"])


def train(sample: pd.DataFrame, epochs: int = EPOCHS, seed: int = 5) -> ByteCNN | None:
    """Fit the network; half of the stretches are cut short, as short texts are to be judged too."""
    classes = sorted(set(sample["lang"]))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for lang, piece in zip(sample["lang"], sample["piece"], strict=True):
        raw = piece.lower().encode()[:WINDOW]
        if rng.random() < 0.5:
            a = int(rng.integers(0, len(raw)))
            raw = raw[a:a + int(rng.integers(12, WINDOW))]
        if raw:
            x.append(windows_of(raw)[0])
            y.append(classes.index(lang))
    net = ByteCNN(classes)
    net.fit(np.stack(x), np.array(y), epochs)
    return net


def predict(net: ByteCNN | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the windows of all texts are scored together."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    asked = [k for k, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
    for a in range(0, len(asked), 256):
        part = asked[a:a + 256]
        raws = [texts[k].lower().encode() for k in part]
        sizes = np.array([len(r) for r in raws])
        counts = -(-sizes // WINDOW)
        logs = net.log_probs(np.concatenate([windows_of(r) for r in raws]))
        first = np.cumsum(counts) - counts
        weight = np.full(len(logs), WINDOW, dtype=np.float64)
        weight[first + counts - 1] = sizes - (counts - 1) * WINDOW
        mean = np.add.reduceat(logs * weight[:, None], first) / sizes[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k, c, s in zip(part, p.argmax(axis=1), p.max(axis=1), strict=True):
            names[k], scores[k] = net.classes[c], float(s)
    return names, scores


def _predictor(net: ByteCNN | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, scores = predict(net, [None if pd.isna(t) else t for t in frame["text"]])
            yield frame.drop(columns="text").assign(lang_pred=names, score=scores, doc_id=frame["doc_id"].astype("Int64"))

    return run


def language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predicted language of every document."""
    ship(docs.sparkSession)
    net = train(training_sample(docs, text_col, lang_col, id_col, per_language))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInPandas(_predictor(net), SCHEMA)


def known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                   min_score: float = 0.3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents, all columns, without those that have no language or an unsure one.

    The verdict is taken where the row is, so nothing is shuffled.
    """
    ship(docs.sparkSession)
    net = train(training_sample(docs, text_col, lang_col, id_col, per_language))

    def judge(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            names, scores = predict(net, [None if pd.isna(t) else t for t in texts])
            yield pd.Series([n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)])

    keep = F.pandas_udf(judge, "boolean")
    return docs.where(keep(F.col(text_col)))
