import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rankweave.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        at = sorted(rng.sample(range(1, 30), rng.randint(2, 10)))
        cost, length = [rng.choice([0.0, 1.0, 3.0]) for _ in at], 12
        best = None
        for n in range(len(at)):
            for inner in itertools.combinations(range(len(at) - 1), n):
                cuts = [*inner, len(at) - 1]
                ends = [at[k] for k in cuts]
                if all(b - a <= length for a, b in zip([0, *ends], ends)):
                    price = sum(cost[k] for k in cuts) + sum(length - (b - a) for a, b in zip([0, *ends], ends))
                    best = price if best is None else min(best, price)
        if best is None:
            continue
        ends = P.best_cuts(at, cost, length)
        price = sum(cost[at.index(e)] for e in ends) + sum(length - (b - a) for a, b in zip([0, *ends], ends))
        assert price == best and ends[-1] == at[-1]


def test_ids_are_the_tokenizers():
    e, t = P.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b", " a", "b ", "x \ny\n\n z", "don't it's 'tis", "1 2  3\t4", "<|endoftext|> a", "中文 😀 ß", "a\x1cb c"]
    for text in texts:
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check(docs, costs=None):
    t = Tokenizer.from_file(PATH)
    rows = P.pack(docs, PATH, costs=costs, partitions=3).collect()
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), tuple(ids)] += 1
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 1024
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for (doc_id, total, ids), times in want.items():
        mine = {k: n for k, n in pieces.items() if k[0] == doc_id and k[4] == total}
        covered = defaultdict(int)
        for (_, start, length, crc, _), n in mine.items():
            if zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc:
                for k in range(start, start + length):
                    covered[k] += n
        assert len(covered) == total and set(covered.values()) == {times}
    assert sum(r.length for r in rows) == sum(k[1] * n for k, n in want.items())
    return rows


def test_every_token_is_in_one_piece(hard_docs, no_docs):
    check(hard_docs)
    check(hard_docs, P.Costs(block_tokens=3000))
    assert P.pack(no_docs, PATH).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.pack(docs, PATH, partitions=2).collect()
    used = sum(r.length for r in rows)
    assert used / (1024 * len({r.sequence_id for r in rows})) > 0.98


def test_a_hot_id_is_dealt_to_many_tasks(spark):
    rows = [(None if k % 2 else k, f"text {k} " * 20) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.pack(docs, PATH, partitions=4)
    ranges = {r.sequence_id >> 40: 0 for r in out.collect()}
    for r in out.where("doc_id IS NULL AND start = 0").collect():
        ranges[r.sequence_id >> 40] += 1
    assert len(ranges) == 4 and max(ranges.values()) < 700 and sum(ranges.values()) == 1000
