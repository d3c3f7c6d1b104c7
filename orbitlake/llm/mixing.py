"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, the number of times the mix should take it. Among
all rates that meet a source's word target and stay within [0, cap], entropy
balancing (Hainmueller 2012) picks those closest to 1 in relative entropy. With a
cost of ``mean size + size`` a document, the solution is an exponential tilt
``r = min(cap, exp(lambda * x))`` with ``x = size / (mean size + size)``: one
multiplier lambda for each source, found by Newton steps on the convex dual.

The gradient of the dual depends on a document's source and size only, so the
steps run over a table of (source, size, documents), one Spark aggregate a step
for all sources. All sums are of integers, so reruns agree.

Rates then become whole copies: ``floor(r + u + shift)`` with u from a hash of
doc_id, where the shift of a source, one of 4097 grid values, is the one whose
taken words come closest to the target. It is read off a histogram with at most
two entries a document and 4097 bins a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import WORD, cut, if_small, table

#: Rates and slopes are counted in millionths, shifts in 2048ths.
UNIT, GRID = 1_000_000, 2048


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds sid (rank of the source) and target to (source, source_size), one row a source.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times
    all words; a target ends at ``cap`` times its source's size and what is over goes to the
    others by weight. The rank needs the sources (not the documents) in one order.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("w", weight.cast("double"))
    full = Window.orderBy("ratio", "sid")
    level = (F.col("all_words") * share - F.col("capped_before")) / F.col("weight_left")
    levels = (
        ranked.withColumn("ratio", cap * F.col("source_size") / F.col("w"))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("capped_before", F.coalesce(F.sum(cap * F.col("source_size")).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "sid", level.alias("level")))).over(every)["level"])
    )
    best = F.least(cap * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), cap * F.col("source_size")))
    return levels.select("sid", "source", "source_size", best.cast("double").alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    """Millionths of a copy."""
    return F.round(F.exp(F.least(lam * x, F.lit(math.log(cap)))) * UNIT).cast("long")


def _x(size: Column, mean: Column) -> Column:
    return size / (mean + size)


def solve(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), tolerance: float = 1e-5, steps: int = 60) -> DataFrame:
    """The mix of (doc_id, source, size) rows: source, source_size, target, mean, lam, shift; a row a source."""
    counts = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goal = targets(sizes.select("source", "source_size"), share, cap, weights)
    goal = goal.join(sizes.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    never = (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    goal = cut(
        goal.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)))
        .drop("docs")
        .withColumns({"lam": F.when(never, F.lit(1e12)).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size"))), "lo": F.lit(-1e9), "hi": F.lit(1e9), "done": never})
    )
    # the rows of a source with documents of one size are a bounded share of this table, whatever their number
    tall = counts.join(if_small(goal.select("sid", F.col("source").alias("s2"), "mean")), F.col("source").eqNullSafe(F.col("s2")))
    tall = cut(tall.where("size > 0").select("sid", "size", "n", _x(F.col("size"), F.col("mean")).alias("x")))
    small = goal.count() <= 200_000
    for _ in range(steps):
        if not goal.where("not done").limit(1).count():
            break
        open_ = goal.where("not done").select("sid", "lam")
        rows = tall.join(F.broadcast(open_) if small else open_, "sid").withColumn("r", _rate(F.col("lam"), F.col("x"), cap))
        amount = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        slope = F.when(F.col("lam") * F.col("x") < math.log(cap), F.round(F.col("r") * F.col("x"))).otherwise(0).cast("decimal(10,0)")
        sums = rows.groupBy("sid").agg(
            F.sum(amount * F.col("r").cast("decimal(10,0)")).cast("double").alias("taken"), F.sum(amount * slope).cast("double").alias("slope")
        )
        gap = F.col("taken") / UNIT - F.col("target")
        goal = (
            goal.join(sums, "sid", "left")
            .withColumn("gap", gap)
            .withColumn("met", F.col("done") | (F.abs("gap") <= tolerance * F.col("target")))
            .withColumns({"lo": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))})
            .withColumn("newton", F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") * UNIT / F.col("slope")))
            .withColumn(
                "middle",  # where a step leaves the bracket: halve it, or while one side is open, go on by doubling
                F.when((F.col("lo") > -1e9) & (F.col("hi") < 1e9), (F.col("lo") + F.col("hi")) / 2).when(F.col("hi") == 1e9, F.abs("lam") * 2 + 1).otherwise(-F.abs("lam") * 2 - 1),
            )
            .withColumn("next", F.when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton")).otherwise(F.col("middle")))
        )
        goal = cut(goal.select("sid", "source", "source_size", "target", "mean", F.when(F.col("met"), F.col("lam")).otherwise(F.col("next")).alias("lam"), "lo", "hi", F.col("met").alias("done")))
    plan = goal.select("sid", "source", "source_size", "target", "mean", "lam")
    points = (
        joined(sized, plan)
        .where("size > 0")
        .select("sid", "size", _point(cap).alias("v"))
        .select("sid", "size", F.explode(F.transform(F.sequence(F.lit(1), F.lit(math.ceil(cap))), lambda k: F.greatest(k * GRID - F.col("v"), F.lit(-GRID)))).alias("at"))
        .where(F.col("at") <= GRID)
        .groupBy("sid", "at")
        .agg(F.sum("size").alias("here"))
    )
    points = points.union(plan.select("sid", F.lit(-GRID - 1).alias("at"), F.lit(0).cast("long").alias("here")))
    so_far = Window.partitionBy("sid").orderBy("at")  # at most 2 * GRID + 2 rows a source
    close = points.withColumn("words", F.sum("here").over(so_far)).join(if_small(plan.select("sid", "target")), "sid")
    shift = close.groupBy("sid").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("d"), "at")).alias("best")).select("sid", F.col("best.at").alias("shift"))
    return cut(plan.join(shift, "sid", "left").withColumn("shift", F.coalesce("shift", F.lit(0))))


def joined(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row of ``docs`` (with source and size) beside its source's row of ``plan``."""
    plan = if_small(plan.withColumnRenamed("source", "plan_source"))
    return docs.join(plan, docs["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")


def _point(cap: float) -> Column:
    """Rate plus the document's hash in [0, 1), in 2048ths."""
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor((_rate(F.col("lam"), _x(F.col("size"), F.col("mean")), cap) / UNIT + u) * GRID).cast("int")


def copies(cap: float = 2.0) -> Column:
    """How often a row of ``joined`` is taken: 0 to ``cap``."""
    return F.least(F.greatest(F.floor((_point(cap) + F.col("shift")) / GRID), F.lit(0)), F.lit(math.floor(cap))).cast("long")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``docs`` (doc_id, text, source and any others), each row as often as the mix takes it.

    Null texts count no words; documents without words are taken at their source's rate of
    1, so they stay. A null source is a source of its own. An empty table stays empty.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = if_small(solve(cut(sized), share, cap, weights).select(F.col("source").alias("of"), F.struct("lam", "mean", "shift").alias("plan")))
    rows = docs.select(F.struct("*").alias("doc"), word_count(F.col("text")).alias("size"))  # one struct a row, so that no name clashes
    rows = rows.join(plan, F.col("doc.source").eqNullSafe(F.col("of")))
    u = F.pmod(F.xxhash64(F.col("doc.doc_id"), F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    rate = _rate(F.col("plan.lam"), _x(F.col("size"), F.col("plan.mean")), cap) / UNIT
    shift = F.when(F.col("size") > 0, F.col("plan.shift")).otherwise(0)
    u = F.when(F.col("size") > 0, u).otherwise(0.0)
    n = F.least(F.greatest(F.floor((F.floor((rate + u) * GRID) + shift) / GRID), F.lit(0)), F.lit(math.floor(cap))).cast("int")
    return rows.select("doc", F.explode(F.array_repeat(F.lit(1), n))).select("doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their size, their source's size and target, and the words the mix takes of them."""
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rows = joined(sized, solve(sized))
    return rows.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"), copies().alias("copies"))
