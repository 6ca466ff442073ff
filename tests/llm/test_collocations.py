import random
import re
from collections import Counter

import duckdb
import numpy as np

from rankweave.llm import collocations as C
from rankweave.llm import transducer as T


def some_counts(seed, n=300, words=9):
    rng = random.Random(seed)
    vocabulary = [bytes([97 + k]) * (1 + k % 3) for k in range(words)]
    return dict(Counter(tuple(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(n)))


def test_an_automaton_holds_its_phrases_and_no_state_twice():
    counts = some_counts(1)
    t = T.of_phrases(counts, 7)
    assert dict(t.phrases()) == counts and t.total == 7
    states = [t.arcs[a:b].tobytes() for a, b in zip(t.starts[:-2], t.starts[1:-1], strict=True)]
    assert len(set(states)) == len(states)
    same = T.of_phrases({(a, b"x", c): 5 for a in (b"p", b"q", b"r") for c in (b"y", b"z")})
    assert len(same.starts) - 1 == 4  # end, after x, after the first word, root


def test_union_adds_up():
    parts = [some_counts(k, n) for k, n in ((1, 200), (2, 50), (3, 1), (4, 300))]
    total = Counter()
    for p in parts:
        total.update(p)
    made = [T.of_phrases(p, 2) for p in parts]
    assert dict(T.union(made).phrases()) == dict(total) and T.union(made).total == 8
    some = T.union(made, 5)
    assert dict(some.phrases()) == {p: c for p, c in total.items() if c >= 5}
    assert set(some.words) == {w for p, c in total.items() if c >= 5 for w in p}
    assert T.union([]).phrases() == [] and T.union([T.of_phrases({})]).phrases() == []


def test_composition_looks_up():
    counts, asked = some_counts(1), some_counts(9, 150, 12)
    got = dict(T.compose(T.of_phrases(asked), T.of_phrases(counts)))
    assert got == {p: counts[p] for p in asked if p in counts} and got
    assert T.compose(T.of_phrases(asked), T.of_phrases({})) == []


def brute(rows, least=C.LEAST, top=C.TOP):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        inside = any(100 * b >= 80 * a for (other, q), b in found.items() if other == lang and len(q) > len(p)
                     and any(q[i:i + len(p)] == p for i in range(len(q))))
        if not inside:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(own, 1)]
    return sorted(ranked)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def random_docs(n, seed=4):
    rng = random.Random(seed)
    fixed = ["New York city", "one two three four", "ÄPFEL und Birnen", "x\ty"]
    words = ["the", "of", "New", "York", "a", "b", "c-d", "Äpfel", "😀", "two"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        texts.append("".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for p in parts))
    return [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts]


def test_against_brute_force(spark):
    rows = random_docs(2500)
    docs = spark.createDataFrame([(k, t, lang, "p", 1) for k, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, part string, a int")
    want = brute(rows)
    assert len({x[0] for x in want}) == 4 and len(want) > 100
    assert rows_of(C.collocations(docs.repartition(5))) == want
    assert rows_of(C.collocations(docs.repartition(2), top=7)) == [x for x in want if x[1] <= 7]


def test_small_shards_change_nothing():
    """Many shards of a few texts, cut in the middle of texts, give the same automata as one."""
    rows = random_docs(60)
    bits = np.full(C.MAP_BITS // 8, 255, np.uint8)

    def all_phrases(lot, size):
        old, C.TEXT_BYTES = C.TEXT_BYTES, size
        found = {}
        try:
            for length in (1, 2, 3):
                made = []
                for a in range(0, len(rows), lot):
                    shard = C.Shard()
                    for _, t in rows[a:a + lot]:
                        for s in C.stretches(t.encode()):
                            shard.add(C.tokens(s))
                    made += [C._unpacked(*row[2:]) for row in C.shard_automata("en", shard, length, bits, 3)]
                whole = T.union(made)
                found[length] = (dict(whole.phrases()), whole.total)
        finally:
            C.TEXT_BYTES = old
        return found
    whole = all_phrases(60, 1 << 22)
    assert whole == all_phrases(1, 16) == all_phrases(7, 50)
    f = Counter()
    for _, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
            w = [x.encode() for x in re.findall(r"[^\x20\x09]+", piece)]
            f.update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    assert {p: c for part, _ in whole.values() for p, c in part.items()} == dict(f)
    assert whole[1][1] == sum(c for p, c in f.items() if len(p) == 1)


def test_whole_table_against_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    res = con.execute(C.SQL)
    names = [d[0] for d in res.description]
    at = [names.index(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    want = sorted(tuple(r[k] for k in at) for r in res.fetchall())
    assert want and rows_of(C.collocations(spark.read.parquet(path))) == want


def test_scores_beyond_64_bits(spark):
    big = 1 << 60
    parts = spark.createDataFrame([("en", "a b", 2, big, 1, 0, "a", 0), ("en", "a b", 2, big, 1, 1, "b", 0)],
                                  "lang string, phrase string, size long, a long, k long, side long, part string, range long")
    counts = spark.createDataFrame([("en", "a", big + 7), ("en", "b", 4 * big)], "lang string, part string, f long")
    assert C.scored(parts, counts).first()["score"] == 2_000_000 * big // (5 * big + 7)


def test_hard_rows(spark, hard_docs, no_docs):
    assert C.collocations(no_docs).count() == 0
    short = hard_docs.where("coalesce(length(text), 0) < 1000")
    assert C.collocations(short).count() == 0  # nothing occurs thirty times
    many = short
    for _ in range(5):
        many = many.unionByName(many)
    got = rows_of(C.collocations(many))
    assert got and got == brute([(r.lang, r.text) for r in many.collect()])
    long = rows_of(C.collocations(hard_docs.where("doc_id = 7"), top=5))  # a cycle of 977 words: 30 times, some 31
    assert len(long) == 5 and {x[3] for x in long} <= {30, 31}
