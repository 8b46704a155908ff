"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

Every document of a source shall be taken ``p = target / size of the source`` times on
average.  The whole part is taken for certain; what remains of all documents of a source is
one fraction f, and pivotal rounding turns those fractions into 0 or 1: the masses of two
documents (fraction times words) are pitted against each other, and words move at random
from one to the other until one of the two is integral, so that every document keeps its
expected copies and the words of the pair stay the same.  A bucket of documents is folded
this way and at most one fraction is left; the fractions left over by the buckets are the
documents of the next level of the reduction tree, up to one document a source, which a
last draw rounds.  The words taken of a source so miss its target by less than that one
document, and a few short documents make up for most of that.

All draws are hashes of ids, source and level: a rerun gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents of a bucket of the reduction tree.
FAN_IN = 512
EPS = 1e-9
WORDS = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in order of their code points (null last) have the weights ``CYCLE``, repeating.
    ``share`` times all words are dealt out by weight; targets stop at ``most`` times the
    source's size, and the excess goes to the others by weight.  The sources that are full
    are those with the smallest size per weight: with them in that order, source i is full
    if what is left after those before it, by weight, is above its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, CYCLE)), (F.row_number().over(order) - 1) % len(CYCLE) + 1)
    )
    total = F.sum("source_size").over(Window.partitionBy())
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    given = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    steps = (
        weighted.withColumn("limit", F.lit(most) * F.col("source_size"))
        .withColumn("level", (F.lit(share) * total - given) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
    )
    final = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("level"))))
    level = final.over(Window.partitionBy())["level"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return steps.select("source", "source_size", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


UNIT = "struct<words:bigint,doc_id:bigint,size:bigint,f:double>"


def _fold(units: Column, level: int, seed: int) -> Column:
    """Pivotal rounding over an array of ``UNIT``; returns every unit with its last f.

    The accumulator holds the finished units and the one that is still fractional.
    """

    def moved(who: Column, by: Column) -> Column:
        f = who["f"] + by / who["words"]
        f = F.when(f < EPS, F.lit(0.0)).when(f > 1 - EPS, F.lit(1.0)).otherwise(f)
        return F.struct(*(who[c].alias(c) for c in ("words", "doc_id", "size")), f.alias("f"))

    def step(acc: Column, unit: Column) -> Column:
        held = acc["held"]
        # words that may move: up to the brim of one or down to nothing of the other
        up = F.least(held["words"] * (1 - held["f"]), unit["words"] * unit["f"])
        down = F.least(held["words"] * held["f"], unit["words"] * (1 - unit["f"]))
        draw = _uniform(held["doc_id"], held["size"], unit["doc_id"], unit["size"], F.lit(level), F.lit(seed))
        move = F.when(draw * (up + down) < down, up).otherwise(-down)
        a, b = moved(held, move), moved(unit, -move)
        a_open = (a["f"] > 0) & (a["f"] < 1)
        later = F.struct(
            F.concat(acc["done"], F.array(F.when(a_open, b).otherwise(a))).alias("done"),
            F.when(a_open, a).otherwise(b).alias("held"),
        )
        return F.when(held.isNull(), F.struct(acc["done"].alias("done"), unit.alias("held"))).otherwise(later)

    start = F.struct(F.array().cast(f"array<{UNIT}>").alias("done"), F.lit(None).cast(UNIT).alias("held"))
    return F.aggregate(units, start, step, lambda acc: F.concat(acc["done"], F.array(acc["held"])))


def rounded(units: DataFrame, seed: int = 0) -> DataFrame:
    """``(source, words, doc_id, size, extra)``: the fractions f of the units rounded to 0 or 1.

    ``units(source, words, doc_id, size, f)`` holds words above 0 that are taken or left
    together, with f between 0 and 1.
    """
    columns = ["source", "words", "doc_id", "size"]
    left, done, level = units, None, 0
    while True:
        counts = materialize(left.groupBy("source").agg(F.count("*").alias("n")), "mix-counts")
        top = counts.agg(F.max("n")).first()[0] or 0
        if top <= 1:
            last = _uniform("doc_id", "source", "size", F.lit(seed), F.lit(-1)) < F.col("f")
            rest = left.select(*columns, last.cast("long").alias("extra"))
            return rest if done is None else done.unionByName(rest)
        counts = counts.select(F.col("source").alias("of"), F.ceil(F.col("n") / FAN_IN).cast("long").alias("buckets"))
        placed = left.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(level), F.lit(seed)), "buckets")
        )
        whole = F.sort_array(F.collect_list(F.struct("words", "doc_id", "size", "f")), asc=False)
        folded = placed.groupBy("source", "bucket").agg(whole.alias("units"))
        folded = folded.select("source", F.explode(_fold(F.col("units"), level, seed)).alias("u")).select("source", "u.*")
        folded = materialize(folded, "mix-level")
        fraction = (F.col("f") > 0) & (F.col("f") < 1)
        settled = folded.filter(~fraction).select(*columns, F.col("f").cast("long").alias("extra"))
        done = settled if done is None else done.unionByName(settled)
        left, level = folded.filter(fraction), level + 1


def corrections(drawn: DataFrame, most: int, seed: int) -> DataFrame:
    """``(source, doc_id, size, copies)``: one copy more or less of a few documents.

    The last draw of a source misses its target by up to one document, which may be long.
    Short documents, in random order, make up for most of that.  They are looked for among
    those that hash into a share of the source that holds about 64 times the words missing,
    so the ordered rows of a source are few.
    """
    gap = F.first("target") - F.sum(F.col("size") * F.col("copies") * F.col("rows"))
    gaps = drawn.groupBy(F.col("source").alias("of")).agg(gap.alias("gap"))
    draw = _uniform("doc_id", "source", "size", F.lit(seed), F.lit(-2))
    near = drawn.filter("rows = 1 and size > 0").join(gaps, F.col("source").eqNullSafe(F.col("of")))
    near = near.filter(
        (draw < F.lit(64.0) * F.abs("gap") / F.col("source_size"))
        & (F.col("size") <= F.greatest(F.abs("gap") / 8, F.least(F.abs("gap"), F.lit(64.0))))
        & F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    )
    running = F.sum("size").over(Window.partitionBy("source").orderBy(draw, "doc_id", "size"))
    return near.withColumn("running", running).filter(F.col("running") <= F.abs("gap")).select(
        "source", "doc_id", "size", F.signum("gap").cast("long").alias("copies")
    )


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often each document is taken; ``doc_id, source, size, source_size, target, copies``.

    One row per row of ``docs``.  Size is the number of words, 0 for null and blank texts,
    which are taken 0 times.  A null source is a source of its own.  Rows alike in id, source
    and size (repeated rows, or rows without id) are taken equally often.  No document is
    taken more than ``ceil(most)`` times.  An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    rows = materialize(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = materialize(source_targets(sizes, share, most), "mix-targets")
    of = targets.select(F.col("source").alias("of"), "source_size", "target")
    p = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("p", p)
    planned = planned.withColumn("whole", F.floor(F.col("p") + EPS)).withColumn("f", F.greatest(F.col("p") - F.col("whole"), F.lit(0.0)))
    planned = planned.drop("of")
    open_ = F.col("f") > EPS
    units = planned.filter(open_).select("source", (F.col("size") * F.col("rows")).alias("words"), "doc_id", "size", "f")
    extra = rounded(units, seed).select("source", "doc_id", "size", "extra")
    # both parts meet by key without a join: one has the plan, the other the draw
    plan = planned.select("source", "doc_id", "size", F.col("whole").alias("extra"), "rows", "source_size", "target")
    both = plan.unionByName(extra, allowMissingColumns=True)
    keys = ["source", "doc_id", "size"]
    merged = both.groupBy(*keys).agg(
        F.sum("extra").alias("copies"), F.max("rows").alias("rows"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
    )
    merged = materialize(merged, "mix-drawn")
    fixes = corrections(merged, math.floor(most), seed)
    merged = merged.unionByName(fixes, allowMissingColumns=True).groupBy(*keys).agg(
        F.sum("copies").alias("copies"), F.max("rows").alias("rows"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
    )
    return merged.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies"
    )
