"""Operator 10, mixing sources to target weights by pivotal dependent rounding.

Each source has a target, and target / size is the number of times that each of its documents
should be taken: a whole part, and a fraction that has to be rounded to 0 or 1. Fractions are
rounded in pairs. Of two documents a and b, words move from one's fraction to the other's
until one fraction is 0 or 1; the direction is drawn with the probabilities that keep both
expectations, and the sum of the words stays. So a source's total moves only when its very
last fraction is rounded; what that adds or takes is given back by turning around other
documents of the root block where that brings the sum nearer. A few documents far longer than
the rest would leave more than the root can give back, so those of a source are settled first,
and the fractions of the others are scaled to take up what is then over or missing.

The pairs form a reduction tree. A document's source and hash give its block of about
``block`` documents; a block is folded from large to small by ``aggregate`` over its array,
leaving one fraction, and the left-over fractions are dealt to blocks again, until a
source has one block. A source with a third of all rows is thus many blocks. Each source
ends at its own depth, whatever the others' sizes, and a source of more than ``block`` documents
comes to its root as ``block`` fractions or nearly so, so there is something to turn around. Each
level is checkpointed, numbers only. Draws are hashes of the documents' ids, and rows equal in
(doc_id, source, size) are one unit with a multiplicity, so reruns agree.

Defined results: null text has size 0; a null source is a source, last in order; a source
without words has target 0 and its rows are taken 0 words; repeated rows share what their unit
is given as evenly as can be; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import cut_lineage, n_words

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 64
#: Documents of so many times their source's mean length are settled before the others.
HEAVY = 16
#: Up to so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, rows, target, ratio.

    Each round shares what is left among the sources below their limit; a source that would
    get more than ``max_copies`` times its size is set to that. The level of the shares only
    rises, so there are no more rounds than sources (mostly one to three). A round is one
    aggregate over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("m").alias("rows"))
    # strings order by their UTF-8 bytes, which is the order of code points
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    shares = F.array(*[F.lit(float(w)) for w in weights])
    table = cut_lineage(totals.withColumn("w", F.element_at(shares, (place % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * float(max_copies)
    level, before = 0.0, -1.0
    while level != before:
        full = F.col("w") * level > limit
        s = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit).otherwise(0.0)).alias("capped"),
                      F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        before = level
        if s["open"]:
            level = max(level, (s["all"] - s["capped"]) / s["open"])
    target = F.least(F.col("w") * level, limit)
    ratio = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_copies))))
    return table.select("source", "source_size", "rows", target.alias("target"),
                        F.coalesce(ratio, F.lit(0.0)).alias("ratio"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


UNIT = "struct<weight:double,p:double,id:bigint,idnull:boolean,size:bigint,m:bigint,base:bigint,up:int>"


def _unit(x: Column, p: Column | None = None, up: Column | None = None) -> Column:
    return F.struct(x["weight"].alias("weight"), (x["p"] if p is None else p).alias("p"), x["id"].alias("id"),
                    x["idnull"].alias("idnull"), x["size"].alias("size"), x["m"].alias("m"),
                    x["base"].alias("base"), (F.lit(None).cast("int") if up is None else up).alias("up"))


def _pair(a: Column, b: Column, seed: int) -> Column:
    """struct(done, left) of one pivotal step between two fractional units."""
    draw = F.pmod(F.xxhash64(F.lit(seed), a["id"], a["size"], b["id"], b["size"]), F.lit(1 << 30)) / float(1 << 30)

    def step(q: Column) -> Column:
        a_up, b_down = (1 - a["p"]) * a["weight"], b["p"] * b["weight"]
        a_down, b_up = a["p"] * a["weight"], (1 - b["p"]) * b["weight"]
        up, down = q["up"], q["down"]
        rises = draw * (up + down) < down
        a_after = F.when(rises, a["p"] + up / a["weight"]).otherwise(a["p"] - down / a["weight"])
        b_after = F.when(rises, b["p"] - up / b["weight"]).otherwise(b["p"] + down / b["weight"])
        a_settles = F.when(rises, a_up <= b_down).otherwise(a_down <= b_up)
        one = F.when(a_settles, rises.cast("int")).otherwise(1 - rises.cast("int"))
        clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        return F.when(a_settles, F.struct(_unit(a, F.lit(0.0), one).alias("done"),
                                          _unit(b, clip(b_after)).alias("left"))
                      ).otherwise(F.struct(_unit(b, F.lit(0.0), one).alias("done"),
                                           _unit(a, clip(a_after)).alias("left")))

    moves = F.struct(F.least((1 - a["p"]) * a["weight"], b["p"] * b["weight"]).alias("up"),
                     F.least(a["p"] * a["weight"], (1 - b["p"]) * b["weight"]).alias("down"))
    return _let(moves, step)


def _fold(units: Column, seed: int) -> Column:
    """Array of the settled units of a block, and last the one that is still open (up null)."""
    state = f"struct<left:{UNIT},done:array<{UNIT}>>"

    def merge(s: Column, x: Column) -> Column:
        first = F.struct(_unit(x).alias("left"), s["done"].alias("done"))
        then = _let(_pair(s["left"], x, seed), lambda r: F.struct(
            r["left"].alias("left"), F.concat(s["done"], F.array(r["done"])).alias("done")))
        return F.when(s["left"].isNull(), first).otherwise(then)

    start = F.struct(F.lit(None).cast(UNIT).alias("left"), F.array().cast(f"array<{UNIT}>").alias("done")).cast(state)
    return F.aggregate(units, start, lambda s, x: merge(s, x).cast(state),
                       lambda s: F.concat(s["done"], F.array(s["left"])))


def _land(units: Column) -> Column:
    """The root's units, all settled: its open one to 0 or 1, and what that adds or takes is given
    back by turning around others, from large to small, wherever that brings the sum of words
    nearer to the target. Both ways are tried, the nearest whole first; the nearer sum counts."""
    opened = F.element_at(units, -1)
    rest = F.sort_array(F.slice(units, 1, F.size(units) - 1), False)
    state = f"struct<over:double,out:array<{UNIT}>>"

    def merge(s: Column, x: Column) -> Column:
        def turn(after: Column) -> Column:
            better = F.abs(after) < F.abs(s["over"])
            return F.struct(F.when(better, after).otherwise(s["over"]).alias("over"), F.concat(
                s["out"], F.array(_unit(x, F.lit(0.0), F.when(better, 1 - x["up"]).otherwise(x["up"])))).alias("out"))

        return _let(s["over"] + F.when(x["up"] == 0, x["weight"]).otherwise(-x["weight"]), turn)

    def landed(up: Column, rank: int) -> Column:
        over = (up - opened["p"]) * opened["weight"]
        start = F.struct(over.alias("over"), F.array(_unit(opened, F.lit(0.0), up)).alias("out")).cast(state)
        return F.aggregate(rest, start, lambda s, x: merge(s, x).cast(state),
                           lambda s: F.struct(F.abs(s["over"]).alias("off"), F.lit(rank).alias("rank"), s["out"].alias("out")))

    near = (opened["p"] >= 0.5).cast("int")
    return F.array_min(F.array(landed(near, 0), landed(1 - near, 1)))["out"]


def decide(units: DataFrame, n_largest: int, block: int = BLOCK, seed: int = 7) -> list[DataFrame]:
    """Settle the fractions of (source, units, weight, p, id, idnull, size, m, base); one table per level.

    ``units`` is the number of these of the source; a source ends in the level where they fit one block
    by its own number, the same as if it were alone.
    """
    out, level = [], 0
    left = units
    while True:
        root = F.col("units") <= block ** (level + 1)
        # at least block of them until the root, which then gets one fraction from each
        blocks = F.when(root, F.lit(1)).otherwise(F.greatest(
            F.ceil(F.col("units") / float(block ** (level + 1))), F.lit(block))).cast("long")
        dealt = left.withColumn("b", F.pmod(F.xxhash64("id", "idnull", "size", F.lit(level)), blocks))
        unit = F.struct(*[F.col(c) for c in ("weight", "p", "id", "idnull", "size", "m", "base")],
                        F.lit(None).cast("int").alias("up"))
        # larger first: reversing an ascending order of (weight, ...) structs
        folded = dealt.groupBy("source", "units", "b").agg(F.sort_array(F.collect_list(unit), False).alias("u"))
        folded = folded.select("source", "units", _fold(F.col("u"), seed + level).alias("u"))
        folded = folded.withColumn("u", F.when(root, _land(F.col("u"))).otherwise(F.col("u")))
        rows = cut_lineage(folded.select("source", "units", F.explode("u").alias("x")).select("source", "units", "x.*"))
        out.append(rows.where("up IS NOT NULL"))
        level += 1
        if n_largest <= block ** level:
            return out
        left = rows.where("up IS NULL").drop("up")


def settle(held: DataFrame, few_sources: bool, block: int = BLOCK) -> list[DataFrame]:
    """Settle the fractions of ``held``: the long documents of each source, then the others."""
    by_source = lambda a, b: a.join(F.broadcast(b) if few_sources else b, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    heavy = (F.col("rows") > block) & (F.col("weight") * F.col("rows") > HEAVY * F.col("source_size"))
    marked = held.withColumn("heavy", heavy)
    words, light = F.col("p") * F.col("weight"), ~F.col("heavy")
    sums = cut_lineage(marked.groupBy(F.col("source").alias("s")).agg(
        F.count_if("heavy").alias("n_heavy"), F.count_if(light).alias("n_light"),
        F.coalesce(F.sum(F.when(F.col("heavy"), words)), F.lit(0.0)).alias("wish"),
        F.coalesce(F.sum(F.when(light, words)), F.lit(0.0)).alias("taken"),
        F.coalesce(F.sum(F.when(light, F.col("weight") - words)), F.lit(0.0)).alias("left")))
    most = sums.agg(F.max("n_heavy").alias("heavy"), F.max("n_light").alias("light")).first()
    parts, over = [], sums.withColumn("over", F.lit(0.0))
    if most["heavy"]:
        long = by_source(marked.where("heavy"), sums.select("s", F.col("n_heavy").alias("units")))
        parts = decide(long, most["heavy"], block)
        up = parts[0]
        for x in parts[1:]:
            up = up.unionByName(x)
        got = up.groupBy(F.col("source").alias("g")).agg(F.sum(F.col("up") * F.col("weight")).alias("got"))
        over = cut_lineage(sums.join(got, F.col("s").eqNullSafe(F.col("g")), "left").withColumn(
            "over", F.coalesce(F.col("got") - F.col("wish"), F.lit(0.0))))
    # the share of the others' words, or of what is still left of them, that makes up for it
    less = F.when(F.col("over") > 0, F.greatest(1 - F.col("over") / F.col("taken"), F.lit(0.0))).otherwise(1.0)
    more = F.when(F.col("over") < 0, F.greatest(1 + F.col("over") / F.col("left"), F.lit(0.0))).otherwise(1.0)
    short = by_source(marked.where(light), over.select("s", F.col("n_light").alias("units"), less.alias("less"), more.alias("more")))
    p = F.when(F.col("more") < 1, 1 - (1 - F.col("p")) * F.col("more")).otherwise(F.col("p") * F.col("less"))
    return parts + decide(short.withColumn("p", p), most["light"] or 1, block)


def unit_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, block: int = BLOCK) -> DataFrame:
    """One row per unit: id, idnull, source, size, m (rows), copies (of all m), source_size, target."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id"),
                       F.col(id_col).isNull().alias("idnull"), F.col(source_col).alias("source"),
                       n_words(F.col(text_col)).alias("size"))
    units = cut_lineage(rows.groupBy("id", "idnull", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = cut_lineage(source_targets(units, weights, max_copies))
    few = targets.count() <= BROADCAST_SOURCES
    table = targets.withColumnRenamed("source", "s")
    if few:
        table = F.broadcast(table)
    held = units.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wish = F.col("m") * F.col("ratio")
    held = (held.withColumn("base", F.floor(wish).cast("long")).withColumn("p", wish - F.col("base"))
            .withColumn("weight", F.col("size").cast("double")))
    fractional = (F.col("p") > 0) & (F.col("weight") > 0)
    parts = settle(held.where(fractional), few, block)
    whole = held.where(~fractional).select("source", "id", "idnull", "size", "m", F.col("base").alias("copies"))
    settled = [x.select("source", "id", "idnull", "size", "m", (F.col("base") + F.col("up")).alias("copies"))
               for x in parts]
    for x in settled:
        whole = whole.unionByName(x)
    about = targets.select(F.col("source").alias("s"), "source_size", "target")
    if few:
        about = F.broadcast(about)
    return whole.join(about, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _row_copies(nth: Column) -> Column:
    """Copies of the unit's nth row (from 1): as even as can be."""
    return F.floor(F.col("copies") / F.col("m")) + (nth <= F.col("copies") % F.col("m")).cast("long")


def mix_sources(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, block: int = BLOCK) -> DataFrame:
    """What is taken of every document."""
    units = unit_copies(docs, text_col, id_col, source_col, weights, max_copies, block)
    rows = units.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("nth"))
    copies = _row_copies(F.col("nth")).cast("long")
    return rows.select(F.when(~F.col("idnull"), F.col("id")).alias("doc_id"), "size", "source_size", "target",
                       (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, block: int = BLOCK) -> DataFrame:
    """The documents of the mix: all columns, a row as often as it is taken.

    Documents without words carry no words to a mix and drop out. Rows are matched by
    (doc_id, source, size): no hot key.
    """
    names = docs.columns
    units = unit_copies(docs, text_col, id_col, source_col, weights, max_copies, block).where("copies > 0")
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                       F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("r_id"),
                       docs[id_col].isNull().alias("r_null"), docs[source_col].isNull().alias("r_sn"),
                       F.coalesce(docs[source_col], F.lit("")).alias("r_s"), n_words(docs[text_col]).alias("r_size"))
    unit = units.where("size > 0").select("copies", "m", "id", "idnull", F.col("source").isNull().alias("sn"),
                                          F.coalesce("source", F.lit("")).alias("sv"), "size")
    met = held.join(unit, (F.col("r_id") == F.col("id")) & (F.col("r_null") == F.col("idnull"))
                    & (F.col("r_s") == F.col("sv")) & (F.col("r_sn") == F.col("sn")) & (F.col("r_size") == F.col("size")))
    w = Window.partitionBy("r_id", "r_null", "r_s", "r_sn", "r_size").orderBy("r_id")
    n = _row_copies(F.col("nth"))
    counted = met.withColumn("nth", F.row_number().over(w)).withColumn("times", n.cast("int")).where("times > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("k")).select("row.*")
