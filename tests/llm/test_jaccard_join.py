import random
import re
from collections import Counter

import numpy as np
import pytest

from rankweave.llm import jaccard_join as J
from rankweave.llm.components import components
from rankweave.llm.shingles import Shingler, apart, parity, prefix_length


def shingle(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [(i, shingle(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = {}
    for k, (_, s) in enumerate(sets):
        common = Counter(j for h in s for j in lists.get(h, ()))
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                root[find(k)] = find(j)
        for h in s:
            lists.setdefault(h, []).append(k)
    ids = {}
    for k, (i, s) in enumerate(sets):
        ids.setdefault(find(k), []).append(i)
    smallest = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, len(s), smallest[find(k)] if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def same(docs):
    got = sorted(map(tuple, J.jaccard_join(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def near_copies(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(w)


def test_components_match_brute_force_on_edited_texts(spark):
    rng = random.Random(5)
    texts = []
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        texts += near_copies(rng, base, rng.choice([2, 5, 40]), max(1, len(base) // 25))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} {' '.join(f'u{rng.randrange(10 ** 6)}' for _ in range(40))}" for _ in range(50)]
    # chains: each text shares most with the next, little with the one after
    words = [f"c{k}" for k in range(400)]
    texts += [" ".join(words[k * 12:k * 12 + 120]) for k in range(20)]
    rng.shuffle(texts)
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6))


def test_boundary_of_the_threshold(spark):
    w = [f"t{k}" for k in range(300)]
    texts = [" ".join(w[:84]), " ".join(w[:104]), " ".join(w[:105]), " ".join(["q", *w[1:84]]), "a b", "A b", "a b c", "a b c d e"]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_hard_rows(hard_docs, no_docs):
    same(hard_docs)
    assert J.jaccard_join(no_docs).count() == 0
    kept = J.keep_one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, None, 7, 9, 10], key=str)


def test_whole_table_matches_brute_force(spark):
    same(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_open_stars_are_compared_member_by_member(spark):
    """Two stars whose leaders don't link, but members of which do."""
    w = [f"w{k}" for k in range(600)]
    texts = [" ".join(w[a:a + 200]) for a in range(0, 60, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(docs)


@pytest.mark.parametrize("n", [1, 2, 5, 37, 500])
def test_prefix_and_block_bounds(n):
    assert prefix_length(n) == n - -(-80 * n // 100) + 1
    for m in range(n, n * 5 // 4 + 1):
        if 100 * n >= 80 * m:
            assert J.size_block(m) - J.size_block(n) in (0, 1)


def test_block_skipping_drops_no_link():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(k, rng.randrange(4), n := rng.randrange(4, 60), rng.randrange(max(1, n - prefix_length(n) + 1), n + 1)) for k in range(9)]
        want = set()
        found = J.join_list(*(np.array(c) for c in zip(*rows)))
        for a in rows:
            for b in rows:
                fits = min(a[3], b[3]) >= -(-80 * (a[2] + b[2]) // 180) and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])
                if a[0] < b[0] and a[1] != b[1] and fits:
                    want.add((a[0], b[0]))
        assert found == want
        assert J.join_list(*(np.array(c) for c in zip(*rows)), len(want)) == want
        assert not want or J.join_list(*(np.array(c) for c in zip(*rows)), len(want) - 1) is None


def crowd(rng, n, size=100, shared=20):
    """Texts that share an edit or two of one base, and are otherwise edited too much to link with most others."""
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    places = rng.sample(range(0, size, 3), shared)
    for _ in range(n):
        w = list(base)
        for p in rng.sample(places, 2):
            w[p] = f"e{p}"
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(size)] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(w)


@pytest.mark.parametrize("tile", [3, 16, 256])
def test_crowded_lists_are_compared_in_tiles(spark, monkeypatch, tile):
    rng = random.Random(tile)
    texts = list(crowd(rng, 150)) + list(crowd(rng, 40, 60, 8))
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "CROWDED", 0.5)
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_a_tile_gives_only_links_that_join_anew():
    rng = random.Random(4)
    s = Shingler()
    sets = [s.set_of(t.encode()) for t in crowd(rng, 60)]
    ids = list(range(60))
    edges = J.compare_tile(ids, ids, [0] * 60, [x.tobytes() for x in sets])
    top = list(ids)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        assert find(a) != find(b) and J._linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        top[find(a)] = find(b)
    for a in ids:
        for b in ids:
            if J._linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                assert find(a) == find(b)
    across = J.compare_tile(ids, ids, [k % 2 for k in ids], [x.tobytes() for x in sets])
    assert all(a % 2 != b % 2 for a, b in across)


def test_partners_leave_out_no_link():
    rng = random.Random(11)
    s = Shingler()
    sets = [s.set_of(t.encode()) for t in crowd(rng, 70)]
    order = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    firsts = [np.frombuffer(J.first_of(x, order), np.uint64).tolist() for x in sets]
    linked = {(a, b) for a in range(70) for b in range(70) if a < b and J._linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    met, entries = set(), 0
    for h in {h for f in firsts for h in f}:
        held = [k for k in range(70) if h in firsts[k]]
        sizes, rests = [len(sets[k]) for k in held], [len(sets[k]) - firsts[k].index(h) for k in held]
        befores = [([k] + firsts[k])[firsts[k].index(h)] % (1 << 62) for k in held]
        found = {held[x] for x in J.partners(held, held, sizes, rests, befores, [0] * len(held), [parity(sets[k]).tobytes() for k in held])}
        met |= {(a, b) for a, b in linked if a in found and b in found}
        entries += len(found)
    assert met == linked and 0 < entries < sum(map(len, firsts)) / 2


def test_whole_sets_go_only_to_tiles_where_they_may_link(spark, monkeypatch):
    """In a crowded list of texts that share a notice but hardly link, bitmaps go to the tiles, not the sets."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10 ** 7)}"
    notice = [word() for _ in range(60)]
    texts = [" ".join(notice + [word() for _ in range(40)]) for _ in range(90)]
    texts += [f"{texts[0]} {word()} {word()}", f"{texts[1]} {word()}"]
    moved = []

    def cut(df, f=J.cut_lineage):
        out = f(df)
        if "low" in df.columns:
            moved.append(out.count())
        return out

    monkeypatch.setattr(J, "TILE", 8)
    monkeypatch.setattr(J, "CROWDED", 0.5)
    monkeypatch.setattr(J, "leaders", lambda sets: sets.select(J.F.col("sid").alias("a"), J.F.col("sid").alias("b")).limit(0))
    monkeypatch.setattr(J, "cut_lineage", cut)
    monkeypatch.setattr(J, "frequent_shingles", lambda docs, n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert len(moved) == 1 and 0 < moved[0] < 92


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool[:rng.integers(2, 3000)], rng.integers(1, 900))) for _ in range(2))
        assert apart(parity(a).tobytes(), parity(b).tobytes()) <= len(np.setxor1d(a, b))
        assert apart(parity(a).tobytes(), parity(a).tobytes()) == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(1000, 1300)} == {1000}


def test_sets_are_the_contracts():
    s = Shingler()
    for t in ["a B c d e f", "a\x0bb c\x0c d e", "a\x1cb c d e f", "a\xa0b c d e f", "Ä b c d e", "x", "a b c d"]:
        assert len(s.set_of(t.encode())) == len(shingle(t))
    assert s.set_of("A b C d e".encode()).tolist() == s.set_of(b"a B c D e").tolist()


def test_rows_without_an_id_meet_only_their_own_set(spark):
    words = [f"w{k}" for k in range(2000)]
    rows = [(None if k % 3 else 7, " ".join(words[40 * (k // 2):40 * (k // 2) + 39] + [f"end{k}"])) for k in range(40)]
    docs = J._rows(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    J.ship(spark)
    scanned = J.cut_lineage(J.scan(docs, (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    sets = scanned.groupBy("sid").agg(J.F.min("doc_id").alias("rep"))
    numbers = [r.sid for r in scanned.orderBy("sid").collect()]
    pairs = spark.createDataFrame(list(zip(numbers[::2], numbers[1::2], strict=True)), "a long, b long")
    held = J._texts(pairs, sets, docs).collect()  # each of 26 and 14 rows of one key with all sets of that key before
    assert sorted(r.sid for r in held) == numbers and {r.text for r in held} == {t for _, t in rows}
    found = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()))) == sorted(map(str, want))


def test_a_small_table_of_edges_is_done_in_one_round(spark, monkeypatch):
    """Each round costs the driver a plan and the cluster a checkpoint; partitions contract their own edges first."""
    from rankweave.llm import components as K
    rounds, nodes = [], list(range(300))
    random.Random(3).shuffle(nodes)
    monkeypatch.setattr(K, "cut_lineage", lambda df, cut=K.cut_lineage: rounds.append(1) or cut(df))
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(n, 0) for n in range(300)]
    assert len(rounds) == 1


def test_edges_of_many_partitions_and_lots_hang_together(spark):
    from rankweave.llm import components as K
    rng = random.Random(8)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(500)]
    top = {}
    for u, v in edges:
        a, b = top.setdefault(u, {u}), top.setdefault(v, {v})
        if a is not b:
            a |= b
            for x in b:
                top[x] = a
    want = sorted((n, min(g)) for n, g in top.items() if len(g) > 1)
    assert list(K.contract([([3, 9], [2, 3]), ([9], [5])], 2)) == [([3, 9], [2, 2]), ([9], [5])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_documents_that_stay_for_sure_are_not_moved(spark, monkeypatch):
    """keep_one_of_each deals out only documents that may have to go or to be looked at row by row."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    rows = [(k, " ".join(word() for _ in range(30))) for k in range(400)]
    rows += [(400 + k, rows[k][1] + " more") for k in range(3)]
    seen = []

    def marked(rows, keys, f=J._marked):
        out = f(rows, keys)
        seen.append(out.where("marked").count())
        return out

    monkeypatch.setattr(J, "_marked", marked)
    kept = J.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert 3 <= seen[-1] <= 6
