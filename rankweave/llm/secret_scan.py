"""Operator 6, secret scans with corpus-wide ownership frequency.

Each whole text is scanned for three kinds of spans (``assign``, ``access``, ``hex``) and for
further candidates: long strings of letters and digits with the spread of a random key. The
value of every span is hashed, and for each hash Spark counts the distinct repositories
and owners that hold it. A repository is a content: copies of a document are one, so copying a document neither adds
to a value's spread nor takes a key away.

Both counts class a value. If its r repositories were drawn among all owners, N (1 - (1 - 1/N)^r) different
owners would be expected, N being the effective number of owners (one over the sum of their squared shares
of the repositories). A value of one owner, or of no more than ``SPECIFIC`` of the owners expected, is
owner-specific and looks ``live``; one of ``MIN_EXAMPLE_OWNERS`` or more that isn't is an example that people
copied; between them, a value of two owners, it is ``shared``. Candidates that are live or shared become spans of that
kind; the base spans stay, whatever their class.

A string has the spread of a random key if it mixes digits and letters of both cases at
``MIN_BITS`` a character, or if its entropy is near that of a random string of its length over its
own alphabet (digits, hex, letters of one case, ...) and it neither reads as words nor counts up.

Counting goes by (hash, owner, repository), then (hash, owner), then hash, each with a map-side
combine, so a value that a third of all rows hold is no hot key. The scan is checkpointed with a
number for each row; the class of each value returns to the rows by that number.

Defined results: null or empty text has no spans; a null owner or repository counts as one owner
or repository; repeated rows are scanned alike and are one repository; an empty table gives
an empty result; texts are scanned whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, ship

KINDS, CLASSES = ("assign", "access", "hex"), ("live", "shared", "example")
# fixed patterns of the base kinds; a match that is too short is dropped after it was found
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the same matches as a longer-than-15 test: shorter ones hold no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")

MIN_BITS = 3.5  # entropy per character of a candidate with digits and letters of both cases
MIN_SHARE = 0.85  # of the entropy that a random string of the same length and alphabet has on average
SPECIFIC = 0.25  # share of the expected owners up to which a value is owner-specific
MIN_EXAMPLE_OWNERS = 3
# neighbouring letters that are common in words of European languages; of random ones about a sixth are
PAIRS = frozenset((
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur "
    "ch ei ie un ic sc be ge di au li la ne me ro ri om co ma el ta ca il us io ce tr no ll ss pe po pr do da qu ai ui em "
    "ec ag ur ul so mo lo ac am ad pa su ho wa we wi ee oo ow ck ly fo ke sh bl ch ht gh rs ts ns tt rt").split())
MAX_PAIRS = 0.45  # share of such pairs in a random string

SCAN = ("doc_id long, owner string, repository string, "
        "spans array<struct<start:int,`end`:int,kind:string,value:binary>>")


def _bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


@lru_cache(maxsize=10_000)
def _expected_bits(letters: int, n: int) -> float:
    """Mean entropy per character of n characters drawn evenly from so many letters."""
    if n > 500:
        return math.log2(letters) - (letters - 1) / (2 * n * math.log(2))
    p, odds = (1 - 1 / letters) ** n, 1 / (letters - 1)
    repeats = 0.0
    for k in range(1, n + 1):  # p: that a letter comes k times
        p *= (n - k + 1) / k * odds
        repeats += p * k * math.log2(k)
    return math.log2(n) - letters * repeats / n


def _alphabet(value: str) -> int:
    """Number of characters that a string with such digits, letters and signs was drawn from."""
    signs = 4 * any(c in "+/_-" for c in value)
    plain = {c for c in value if c.isalnum()}
    if plain <= set("0123456789"):
        return 10 + signs
    if plain <= set("0123456789abcdef") or plain <= set("0123456789ABCDEF"):
        return 16 + signs
    return 10 * any(c.isdigit() for c in plain) + 26 * any(c.islower() for c in plain) + 26 * any(
        c.isupper() for c in plain) + signs


def _reads_or_counts(value: str) -> bool:
    """Words, or characters that go on by one step like 012345 or abcdef."""
    lower = value.lower()
    letters = [a + b for a, b in zip(lower, lower[1:]) if a.isalpha() and b.isalpha()]
    steps = Counter(ord(b) - ord(a) for a, b in zip(value, value[1:]))
    words = len(letters) > len(value) / 3 and sum(x in PAIRS for x in letters) > MAX_PAIRS * len(letters)
    return words or max(steps.values()) > len(value) / 2


def _looks_random(value: str) -> bool:
    bits = _bits(value)
    mixed = any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)
    if mixed and bits >= MIN_BITS:
        return True
    return bits >= MIN_SHARE * _expected_bits(_alphabet(value), len(value)) and not _reads_or_counts(value)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):  # lower() leaves no keyword of A-Z letters unseen
        found += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class IntervalSet:
    """Spans by start, with the furthest end up to each: whether one meets a stretch is a bisection."""

    def __init__(self, spans: list[tuple[int, int, str, str]]):
        self.starts = [x[0] for x in spans]
        self.ends = list(accumulate((x[1] for x in spans), max))

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Random-looking strings that overlap no base span."""
    taken, out = IntervalSet(base), []
    for m in CANDIDATE.finditer(text):
        if _looks_random(m[0]) and not taken.meets(*m.span()):
            out.append((*m.span(), "live", m[0]))
    return out


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        spans = []
        for text in frame["text"]:
            base = base_spans(text)
            spans.append([{"start": a, "end": b, "kind": k, "value": hashlib.sha256(v.encode()).digest()[:16]}
                          for a, b, k, v in [*base, *candidates(text, base)]])
        yield frame.drop(columns="text").assign(doc_id=frame["doc_id"].astype("Int64"), spans=spans)


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories) of (value, owner, repository) rows."""
    pairs = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"),
                                       F.sum("repositories").alias("repositories"))


def effective_owners(scanned: DataFrame) -> float:
    """One over the sum of the owners' squared shares of the repositories; 1 without any."""
    held = scanned.select("owner", "repository").distinct().groupBy("owner").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = held.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
    return sums["n"] ** 2 / sums["squares"] if sums["n"] else 1.0


def value_class(owners, repositories, effective: float):
    """'live', 'shared' or 'example', from both counts and the effective number of owners."""
    expected = F.lit(effective) * (1 - F.pow(F.lit(1 - 1 / effective), repositories))
    return F.when((owners == 1) | (owners <= SPECIFIC * expected), "live").when(
        owners >= MIN_EXAMPLE_OWNERS, "example").otherwise("shared")


def secret_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source",
                repository_col: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, base and all spans, and counts of live, shared and example values.

    Without a ``repository_col`` a repository is a distinct text.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    repository = F.xxhash64(text) if repository_col is None else F.col(repository_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                       repository.cast("string").alias("repository"), text.alias("text"))
    scanned = cut_lineage(rows.mapInPandas(_scan, SCAN).withColumn("row", F.monotonically_increasing_id()))
    spans = scanned.select("row", "owner", "repository", F.explode("spans").alias("s")).select(
        "row", "owner", "repository", "s.*")
    shared = ownership(spans.select("value", "owner", "repository")).withColumn(
        "class", value_class(F.col("owners"), F.col("repositories"), effective_owners(scanned)))
    classed = spans.join(shared, "value").select("row", "start", "end", "kind", "class")
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(
        F.col("kind") == "hex", 2).otherwise(3)
    keeps = (F.col("class") != "example") | (F.col("kind") != "live")
    kind = F.when(F.col("kind") == "live", F.col("class")).otherwise(F.col("kind")).alias("kind")
    # a group is the spans of one text
    texts = classed.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(keeps, F.struct("start", order.alias("o"), "end", kind)))).alias("all"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        *[F.count_if(keeps & (F.col("class") == k)).alias(f"n_{k}") for k in CLASSES])
    write = lambda spans: F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    none = F.array().cast("array<struct<start:int,o:int,`end`:int,kind:string>>")
    found = scanned.select("row", "doc_id").join(texts, "row", "left").withColumn("all", F.coalesce("all", none))
    return found.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(write(F.filter("all", lambda x: ~x["kind"].isin(*CLASSES))).cast("binary"), 256).alias("base_sha256"),
        write(F.col("all")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [f"n_{k}" for k in CLASSES]])
