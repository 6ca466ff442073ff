"""Operator 12, phrase collocation mining by weighted acyclic automata.

1. **Shards.** A task reads its texts into shards of a bounded number of words. A shard's n-grams are sorted and
   built incrementally into counting automata (``transducer``), one for each language and prefix range: the
   hash of the first two words says which range a phrase belongs to.
2. **Union.** The automata of a language and range meet in one task, which adds their weights up and keeps phrases found
   ``LEAST`` times or more. This is done for words, then for pairs of kept words, then for phrases of three and four
   words whose pairs are all kept: a phrase is never more frequent than a part of it, so nothing else can be a
   candidate or a part of one. Tasks know the kept words and pairs by a bitmap of a fixed size; a false
   positive there costs work, not results.
3. **Parts.** The parts of the candidates are sorted into automata of their own, and composed with the counting
   automata of their ranges; every part is a kept phrase, so a range is asked for no more than it holds.
4. Scores are exact decimals; the best cut, the phrases inside longer ones and each language's first rows are
   aggregates and windows.

A range is one of so many that it covers about RANGE_CHARS characters of text. A frequent phrase is one
path of each shard's automaton, however often it occurs.

Defined results: null, empty and blank texts have no words; a null language is ``und``, together with
documents that say so; repeated rows count as often as they stand there; ids play no part, so null ids don't
matter; other columns are ignored; ties go by the phrase's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, ship
from rankweave.llm.transducer import ARC, Transducer, build, compose, narrowed, of_phrases, union

LEAST, LONGEST, TOP = 30, 4, 2_000
INSIDE = 80                  # percent of a phrase's count that a longer one needs to replace it
SCALE = 2_000_000
SHARD_WORDS = 4_000_000
RANGE_CHARS = 16_000_000
MAP_BITS = 1 << 24
TEXT_BYTES = 1 << 22         # longer texts are read in stretches that end where a piece does
# fixed values: the signs that end a piece; 0xFF is no part of UTF-8 and marks such an end
BREAKS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
TO_MARK = bytes.maketrans(BREAKS, MARK * len(BREAKS))
AUTOMATON = "lang string, range long, words binary, starts binary, arcs binary, total long"


def stretches(raw: bytes) -> Iterator[bytes]:
    """A text in lower case with marked ends of pieces, in stretches of whole pieces."""
    raw = raw.lower().translate(TO_MARK)
    begin = 0
    while len(raw) - begin > TEXT_BYTES:
        cut = raw.rfind(MARK, begin, begin + TEXT_BYTES)
        if cut < 0:
            cut = raw.find(MARK, begin)
        if cut < 0:
            break
        yield raw[begin:cut]
        begin = cut + 1
    yield raw[begin:]


def tokens(stretch: bytes) -> list[bytes]:
    """Words, and marks between pieces. Of the signs that split() cuts at, only blank and tab are left here."""
    return stretch.replace(MARK, b" \xff ").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], dtype=np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x9E3779B97F4A7C15) + _mix(second))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(ranges)).astype(np.int64)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(MAP_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Shard:
    """Words of one language in reading order, as places in a list; 0 is the end of a piece."""

    def __init__(self):
        self.place: dict[bytes, int] = defaultdict(count().__next__)
        self.place[MARK]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, found: list[bytes]) -> None:
        place = self.place
        self.parts += [np.fromiter([place[w] for w in found], dtype=np.int32, count=len(found)), np.zeros(1, np.int32)]
        self.size += len(found) + 1

    def sorted_words(self) -> tuple[list[bytes], np.ndarray]:
        """The alphabet in order, and the text as places in it; -1 is the end of a piece."""
        words = list(self.place)[1:]
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.full(len(words) + 1, -1, dtype=np.int64)
        rank[np.array(order, dtype=np.int64) + 1] = np.arange(len(words))
        return [words[k] for k in order], rank[np.concatenate(self.parts)]


def ngrams(lang: str, shard: Shard, length: int, bits: np.ndarray | None):
    """(words, labels, counts, hash of the prefix, number of words) of a shard's n-grams of this length (3: and of 4)."""
    words, text = shard.sorted_words()
    hashes, v, is_word = word_hashes(lang, words), len(words), text >= 0
    total = int(is_word.sum())
    if length == 1:
        counts = np.bincount(text[is_word], minlength=v)
        return words, np.arange(v)[:, None], counts, hashes, total
    if length == 2:
        known = np.concatenate([held(bits, hashes), [False]])[text]  # the last one serves -1
        at = np.flatnonzero(known[:-1] & known[1:])
        keys, counts = np.unique(text[at] * v + text[at + 1], return_counts=True)
        a, b = keys // max(v, 1), keys % max(v, 1)
        return words, np.stack([a, b], axis=1), counts, pair_hashes(hashes[a], hashes[b]), 0
    pairs = is_word[:-1] & is_word[1:]
    at = np.flatnonzero(pairs)
    pairs[at] = held(bits, pair_hashes(hashes[text[at]], hashes[text[at + 1]]))
    at = np.flatnonzero(pairs[:-1] & pairs[1:])
    two, place = np.unique(text[at] * v + text[at + 1], return_inverse=True)
    three, place, counts = np.unique(place * v + text[at + 2], return_inverse=True, return_counts=True)
    a, b, c = two[three // max(v, 1)] // max(v, 1), two[three // max(v, 1)] % max(v, 1), three % max(v, 1)
    labels = np.stack([a, b, c, np.full(len(a), -1)], axis=1)
    longer = np.flatnonzero(pairs[np.minimum(at + 2, len(pairs) - 1)] & (at + 2 < len(pairs)))
    four, more = np.unique(place[longer] * v + text[at[longer] + 3], return_counts=True)
    first = four // max(v, 1)
    wide = np.stack([a[first], b[first], c[first], four % max(v, 1)], axis=1)
    labels, counts = np.concatenate([labels, wide]), np.concatenate([counts, more])
    return words, labels, counts, pair_hashes(hashes[labels[:, 0]], hashes[labels[:, 1]]), 0


def _packed(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def _row(lang: str, part: int, t: Transducer) -> tuple:
    """An AUTOMATON row. Words are joined by marks; of arcs the steps between labels, the targets and the weights follow each other."""
    arcs = b"".join([np.diff(t.arcs["label"], prepend=np.int32(0)).tobytes(), t.arcs["target"].tobytes(), t.arcs["weight"].tobytes()])
    return lang, part, _packed(MARK.join(t.words)), _packed(np.diff(t.starts).astype(np.int32).tobytes()), _packed(arcs), t.total


def _unpacked(words: bytes, starts: bytes, arcs: bytes, total: int) -> Transducer:
    words, sizes = zstandard.decompress(words), np.frombuffer(zstandard.decompress(starts), np.int32)
    raw = zstandard.decompress(arcs)
    n = len(raw) // ARC.itemsize
    out = np.zeros(n, ARC)
    out["label"] = np.cumsum(np.frombuffer(raw, np.int32, n), dtype=np.int32)
    out["target"] = np.frombuffer(raw, np.int32, n, 4 * n)
    out["weight"] = np.frombuffer(raw, np.int64, n, 8 * n)
    return Transducer(words.split(MARK) if words else [], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), out, total)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in AUTOMATON.split(", ")])


def _of_table(table: pa.Table) -> list[Transducer]:
    return [_unpacked(*row) for row in zip(*[table.column(c).to_pylist() for c in ("words", "starts", "arcs", "total")], strict=True)]


def shard_automata(lang: str, shard: Shard, length: int, bits: np.ndarray | None, ranges: int) -> Iterator[tuple]:
    """One automaton of a shard's n-grams for each range that they fall into."""
    words, labels, counts, hashes, total = ngrams(lang, shard, length, bits)
    part = range_of(hashes, ranges)
    order = np.lexsort((*labels.T[::-1], part))
    part, labels, counts = part[order], labels[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, inside = narrowed(words, labels[a:b])
        yield _row(lang, int(part[a]), build(own, inside, counts[a:b], total if a == 0 else 0))


def level(docs: DataFrame, length: int, bits: np.ndarray | None, ranges: int) -> DataFrame:
    """AUTOMATON rows of all n-grams of this length (3: and of 4) that occur LEAST times or more."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # MAP_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = defaultdict(Shard)
        read = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(shards):
                for row in shard_automata(lang, shards.pop(lang), length, sent.value, ranges):
                    yield _batch([row])

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for stretch in stretches(raw or b""):
                    found = tokens(stretch)
                    if found:
                        shards[lang].add(found)
                        read += len(found)
                    if read > SHARD_WORDS:
                        yield from flush()
                        read = 0
        yield from flush()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        found = union(_of_table(table), LEAST)
        return pa.Table.from_batches([_batch([_row(key[0].as_py(), key[1].as_py(), found)])])

    rows = docs.select("lang", "text").mapInArrow(run, AUTOMATON)
    return cut_lineage(rows.groupBy("lang", "range").applyInArrow(add, AUTOMATON))


def bitmap(automata: DataFrame) -> np.ndarray:
    """MAP_BITS bits over the hashes of an automata table's words or pairs of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for lang, t in zip(batch.column(0).to_pylist(), _of_table(batch), strict=True):
                labels, hashes = t.paths()[0], word_hashes(lang, t.words)
                if len(labels):
                    found.append(hashes[labels[:, 0]] if labels.shape[1] == 1 else pair_hashes(hashes[labels[:, 0]], hashes[labels[:, 1]]))
            at = np.concatenate(found) & np.uint64(MAP_BITS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    bits = automata.mapInArrow(run, "at long").groupBy(F.expr("at div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()  # MAP_BITS / 64 rows at most
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    out[bits["w"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint8)


def cuts(automata: DataFrame, ranges: int) -> DataFrame:
    """(lang, phrase, size, a, k, part, range, side) of every candidate's two parts (side 0: first) at each cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), _of_table(batch), strict=True):
                labels, weights = t.paths()
                if not len(labels):
                    continue
                hashes = word_hashes(lang, t.words)
                words = [w.decode() for w in t.words]
                rows = []
                for p, a in zip(labels.tolist(), weights.tolist(), strict=True):
                    p = [x for x in p if x >= 0]
                    phrase = " ".join([words[x] for x in p])
                    for k in range(1, len(p)):
                        rows += [(phrase, len(p), a, k, side, " ".join([words[x] for x in part]), part[0], part[1] if len(part) > 1 else -1)
                                 for side, part in enumerate((p[:k], p[k:]))]
                *columns, one, two = zip(*rows, strict=True)
                one, two = np.array(one), np.array(two)
                h = np.where(two < 0, hashes[one], pair_hashes(hashes[one], hashes[two]))
                columns = [[lang] * len(rows), *columns, range_of(h, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])

    schema = "lang string, phrase string, size long, a long, k long, side long, part string, range long"
    return automata.mapInArrow(run, schema)


def part_counts(asked: DataFrame, automata: DataFrame) -> DataFrame:
    """(lang, part, f) of the parts (lang, range, part) asked for, by composition with their ranges' automata."""
    def look(key: tuple, parts: pa.Table, counts: pa.Table) -> pa.Table:
        wanted = of_phrases({tuple(p.encode().split(b" ")): 1 for p in parts.column("part").to_pylist()})
        found = [x for t in _of_table(counts) for x in compose(wanted, t)] if parts.num_rows else []
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found), pa.string()),
                         "part": pa.array([b" ".join(p).decode() for p, _ in found], pa.string()),
                         "f": pa.array([f for _, f in found], pa.int64())})

    met = asked.groupBy("lang", "range").cogroup(automata.groupBy("lang", "range"))
    return met.applyInArrow(look, "lang string, part string, f long")


def scored(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each candidate at its lowest-scoring cut, ties at the first."""
    known = parts.join(counts, ["lang", "part"])
    sides = known.groupBy("lang", "phrase", "size", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r)").cast("long")
    best = sides.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def outside(found: DataFrame) -> DataFrame:
    """The candidates without those that a longer one, of INSIDE percent of their count, holds."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size").cast("int") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size").cast("int") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    held_by = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    met = found.join(held_by, ["lang", "phrase"], "left")
    dropped = F.lit(100).cast("decimal(3,0)") * F.col("longer") >= F.lit(INSIDE).cast("decimal(3,0)") * F.col("a")
    return met.where(~F.coalesce(dropped, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS)
    one = level(rows, 1, None, ranges)
    two = level(rows, 2, bitmap(one), ranges)
    long = level(rows, 3, bitmap(two), ranges)
    parts = cut_lineage(cuts(two.unionByName(long), ranges))
    counts = part_counts(parts.select("lang", "range", "part").distinct(), one.unionByName(two).unionByName(long))
    totals = one.groupBy("lang").agg(F.sum("total").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = outside(cut_lineage(scored(parts, counts))).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE i + s - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
cut_scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
    CAST(2000000 AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) + y.a) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
starts AS (SELECT lang, a, size, string_split(phrase, ' ') AS w, unnest(range(1, size + 1)) AS i FROM f WHERE size > 2),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM starts, (SELECT unnest([2, 3]) AS s) WHERE s < size AND i + s - 1 <= size GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
    b.phrase, b.a, b.l, b.r, CAST(b.score AS BIGINT) AS score
  FROM best b LEFT JOIN inner_phrases p ON p.lang = b.lang AND p.phrase = b.phrase
  WHERE NOT coalesce(100 * p.longer >= 80 * b.a, false))
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
