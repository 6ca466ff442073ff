"""Operator 5, packing: order-preserving dynamic programming over cut points.

Documents are tokenized, each closed by an end token, and laid end to end in the order of their
ids. A dynamic programme chooses where the windows of at most ``length`` tokens end. It may
cut behind a document (free), behind a sentence (``sentence_cut``) or, inside a sentence
longer than ``long_sentence``, every ``step`` tokens (``inner_cut``); a window that doesn't
reach ``length`` pays its padding. With f(j) the least cost of cutting at j,

    f(j) = cut(j) + length - j + min over i in [j - length, j) of (f(i) + i),

and the minimum slides along with j, so a monotone queue gives each f(j) in constant time.

Spark deals ranges of ids to tasks and sorts them; a task packs its range on its own. A task
holds about ``block_tokens`` tokens at a time: when they are there, all windows of the best path
but the last are final, and the last one's tokens open the next block. Only the last window
of a task's range is left with padding for want of tokens.

Defined results: null text is the empty text, whose document is its end token; null ids come
first; repeated rows are packed as often as they occur (rows of one id are ordered by a hash of the text, then by
the text, and may span ranges; only rows equal in id and text always share one);
an empty table gives an empty result; a text of any length is cut into as many pieces as
needed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import ship

LENGTH = 1024
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


class Costs:
    """Penalties in tokens of padding."""

    def __init__(self, length: int = LENGTH, sentence_cut: float = 2.0, inner_cut: float = 12.0,
                 long_sentence: int = 64, step: int = 8, block_tokens: int = 1 << 20):
        if long_sentence + step > length:
            raise ValueError("a window must always hold a cut point")
        self.length, self.sentence_cut, self.inner_cut = length, sentence_cut, inner_cut
        self.long_sentence, self.step, self.block_tokens = long_sentence, step, block_tokens


# fixed value: how a byte-level tokenizer of this kind splits a text before it merges bytes
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts by a tokenizer file, and which ids end a sentence.

    Texts go through a fast implementation of the byte merges, filled from the same file; those
    that hold a special token go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        symbols = _byte_symbols()
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self.merges = tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        texts = self.tokenizer.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        self.ends = np.array([bool(re.search(r"[.!?][\"')\]]*$|\n", x)) for x in texts])
        self.breaks = np.array([bool(re.match(r"\s", x)) for x in texts])

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.merges.encode_to_numpy(text, disallowed_special=())

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions behind the last token of a sentence."""
        return np.flatnonzero(self.ends[ids[:-1]] & (self.breaks[ids[1:]] | self.breaks[ids[:-1]])) + 1


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Where documents laid end to end may be cut, in order, and at which cost."""
    inner = np.setdiff1d(sentence_ends, doc_ends, assume_unique=True)
    marks = np.concatenate([doc_ends, inner])
    price = np.concatenate([np.zeros(len(doc_ends)), np.full(len(inner), costs.sentence_cut)])
    order = np.argsort(marks, kind="stable")
    marks, price = marks[order], price[order]
    starts = np.concatenate([[0], marks[:-1]])
    gaps = marks - starts
    more = np.where(gaps > costs.long_sentence, (gaps - 1) // costs.step, 0)
    if total := int(more.sum()):
        nth = np.arange(total) - np.repeat(np.cumsum(more) - more, more) + 1
        marks = np.concatenate([marks, np.repeat(starts, more) + nth * costs.step])
        price = np.concatenate([price, np.full(total, costs.inner_cut)])
        order = np.argsort(marks, kind="stable")
        marks, price = marks[order], price[order]
    return marks, price


def best_cuts(at: list[int], cost: list[float], length: int) -> list[int]:
    """The cheapest increasing choice of points that ends with the last one, no step over length.

    ``keys``, ``places`` and ``points`` are the monotone queue from ``head`` on: values of
    f(i) + i that rise, at positions i that rise.
    """
    came: list[int] = []
    keys, places, points, head = [0.0], [0], [-1], 0
    for k, j in enumerate(at):
        low = j - length
        while places[head] < low:
            head += 1
        came.append(points[head])
        key = cost[k] + length + keys[head]  # f(j) + j
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            places.pop()
            points.pop()
        keys.append(key)
        places.append(j)
        points.append(k)
    cuts, k = [], len(at) - 1
    while k >= 0:
        cuts.append(at[k])
        k = came[k]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; pieces come out in order."""

    def __init__(self, encoder: Encoder, costs: Costs, first_sequence: int = 0, end_id: int = 0):
        self.encoder, self.costs, self.sequence = encoder, costs, first_sequence
        self.end = np.array([end_id], dtype=np.uint32)
        self.ids = np.zeros(0, np.uint32)  # tokens that aren't in a final window yet
        self.at, self.cost = np.zeros(0, np.int64), np.zeros(0)
        self.names: list = []  # the documents of these tokens,
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # their first token's place and length

    def add(self, names: list, texts: list[str]) -> list[tuple]:
        tokens = [self.encoder.encode(x) for x in texts]
        sizes = np.array([len(x) + 1 for x in tokens])
        ids = np.concatenate([x for t in tokens for x in (t, self.end)])
        ends = np.cumsum(sizes)
        at, cost = cut_points(ends, self.encoder.sentence_ends(ids), self.costs)
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.at, self.cost = np.concatenate([self.at, at + base]), np.concatenate([self.cost, cost])
        self.names += names
        self.begins = np.concatenate([self.begins, ends - sizes + base])
        self.sizes = np.concatenate([self.sizes, sizes])
        return self.close(False) if len(self.ids) >= self.costs.block_tokens else []

    def close(self, final: bool = True) -> list[tuple]:
        cuts = best_cuts(self.at.tolist(), self.cost.tolist(), self.costs.length)[:None if final else -1]
        if not cuts:
            return []
        done = int(cuts[-1])
        cuts = np.array(cuts)
        starts = np.unique(np.concatenate([[0], cuts[:-1], self.begins[(self.begins > 0) & (self.begins < done)]]))
        stops = np.append(starts[1:], done)
        doc = np.searchsorted(self.begins, starts, side="right") - 1
        window = np.searchsorted(cuts, starts, side="right")
        opens = np.concatenate([[0], cuts])[window]
        raw = memoryview(self.ids[:done].astype("<u4").tobytes())
        crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        out = list(zip([self.names[k] for k in doc.tolist()], (starts - self.begins[doc]).tolist(),
                       (stops - starts).tolist(), crcs, self.sizes[doc].tolist(),
                       (window + self.sequence).tolist(), (starts - opens).tolist(), strict=True))
        self.sequence += len(cuts)
        left = int(np.searchsorted(self.begins + self.sizes, done, side="right"))
        self.names, self.sizes = self.names[left:], self.sizes[left:]
        self.begins = self.begins[left:] - done
        held = self.at > done
        self.ids, self.at, self.cost = self.ids[done:], self.at[held] - done, self.cost[held]
        return out


_ENCODERS: dict[str, Encoder] = {}


def _packer(path: str, costs: Costs, end_id: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        packer = Packer(_ENCODERS[path], costs, TaskContext.get().partitionId() << 40, end_id)
        columns = SCHEMA.replace(" long", "").split(", ")

        def table(pieces: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(pieces, columns=columns).astype({"doc_id": "Int64"})

        for frame in frames:
            names = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
            texts = frame["text"].tolist()
            for a in range(0, len(texts), 200):
                if pieces := packer.add(names[a:a + 200], texts[a:a + 200]):
                    yield table(pieces)
        if pieces := packer.close():
            yield table(pieces)

    return pack


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id",
         costs: Costs | None = None, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """One row per piece of a document."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # an id that many rows share, or none, is cut into ranges by its texts
    order = [F.col("doc_id").asc_nulls_first(), F.col("by_text")]
    ranged = rows.withColumn("by_text", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("by_text")
    return ranged.mapInPandas(_packer(tokenizer_path, costs or Costs(), end_id), SCHEMA)
