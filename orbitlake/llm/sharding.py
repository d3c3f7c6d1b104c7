"""Dealing documents into shards by balanced label propagation.

Documents are linked if their texts are equal, or if they share a passage anywhere, as near copies do. A text
is cut into passages after each line and after each word that its own hash marks, so that an
edit changes the passages around it only; those of at least PASSAGE characters count, all of them, and so do the first and last line and the
first 64 characters if they have SHORTEST.
Equal texts are one unit, or, if they outgrow three quarters of a shard's quota, several units
that split them by hash. Units and what they share form a two-sided graph, so that links are never listed as pairs.

Every linked unit starts in a shard that its hash names. Then, round by round, joins tally
for each shared piece how many rows of its units are in which shard, and for each unit how many neighbours
it has in each shard (Ugander and Backstrom, "Balanced label propagation for partitioning
massive graphs", 2013). A unit moves to the shard with most neighbours if that cuts fewer links and the
shard's quota of rows has room; only one half of the units, picked by hash, may move in a
round, so that neighbours don't swap. This ends when two rounds move nothing. Documents without links then
fill what is left of each quota. The law is ``rows``: shards' counts end at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import cut, if_small, shuffles_go, table

#: Rows that one bucket of a rank holds about; characters that a shared piece has at least; rounds at most.
BUCKET_ROWS, SHORTEST, ROUNDS = 20_000, 20, 8
#: Characters that a shared passage has at least; one of so many words ends a passage.
PASSAGE, WORDS = 40, 16
KEY = ["text_hash", "text_crc32", "size"]


def _hash(*what: Column | str) -> Column:
    return F.xxhash64(*what)


def passages(text: Column) -> Column:
    """The passages of a text, trimmed, from its first to its last word."""
    marked = F.transform(F.split(text, " ", -1), lambda w: F.when(F.pmod(_hash(w), F.lit(WORDS)) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
    return F.transform(F.split(F.array_join(marked, " "), "\n", -1), lambda x: F.trim(x))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and 8), text_crc32, text_hash, and hashes of the pieces that link texts; a null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ends = [F.substring_index(text, "\n", 1), F.substring_index(text, "\n", -1), F.substring(text, 1, 64)]
    long = F.array_compact(F.array(*[F.when(F.length(F.trim(x)) >= SHORTEST, _hash(F.trim(x))) for x in ends]))
    whole = F.transform(F.filter(passages(text), lambda x: F.length(x) >= PASSAGE), lambda x: _hash(x))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _hash(text).alias("text_hash"), F.array_distinct(F.concat(long, whole)).alias("pieces"))


def _ranked(rows: DataFrame, group: list[str], name: str, total: int) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within ``group``, without a group in one task.

    Rows are counted by hash buckets; a bucket's rank starts where those before it end.
    Rows that are equal in all columns share what is left of the order at random.
    """
    rows = rows.withColumn("bucket", F.pmod(_hash("doc_id", "text_hash", "size"), F.lit(1 + total // BUCKET_ROWS)).cast("int"))
    sums = rows.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    within = Window.partitionBy(*group, "bucket").orderBy("doc_id", "text_hash", "size")
    return rows.withColumn("rn", F.row_number().over(within) - 1).join(if_small(starts), [*group, "bucket"]).withColumn(name, (F.col("start") + F.col("rn")).cast("long")).drop("bucket", "start", "rn")


def _graph(units: DataFrame, most: float) -> DataFrame:
    """(unit, n, piece) for every piece that several ``units`` (unit, n, pieces) share; pieces of more than ``most`` rows are split by hash."""
    each = units.select("unit", "n", F.explode("pieces").alias("piece"))
    shared = each.groupBy("piece").agg(F.count("*").alias("units"), F.sum("n").alias("rows")).where("units > 1")
    shared = cut(shared.select("piece", F.ceil(F.col("rows") / F.lit(most)).cast("int").alias("parts")))
    return cut(each.join(if_small(shared), "piece").select("unit", "n", _hash("piece", F.pmod(_hash("unit", F.lit("part")), F.col("parts"))).alias("piece")))


def _accept(proposals: DataFrame, free: list[int]) -> DataFrame:
    """Those of ``proposals`` (unit, n, label) that fit: larger units first, then by hash, as far as a shard's free rows reach.

    Whole bins of a histogram with at most 64 * 64 bins a shard are taken.
    """
    binned = proposals.withColumn("bin", (F.lit(63) - F.floor(F.log2(F.col("n")))) * 64 + F.pmod(_hash("unit", F.lit("bin")), F.lit(64)))
    sums = binned.groupBy("label", "bin").agg(F.sum("n").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy("label").orderBy("bin"))
    limit = F.element_at(F.array(*[F.lit(x) for x in free]), F.col("label") + 1)
    taken = sums.withColumn("total", total).where(F.col("total") <= limit).select("label", "bin")
    return binned.join(F.broadcast(taken), ["label", "bin"], "left_semi").drop("bin")


def _tally(graph: DataFrame) -> DataFrame:
    """Rows of each piece by label."""
    return graph.groupBy("piece", F.col("label").alias("to")).agg(F.sum("n").alias("rows"))


def links_cut(graph: DataFrame) -> float:
    """Linked pairs of rows that different shards hold, counted once for each piece they share."""
    rows = F.col("rows").cast("double")
    pieces = _tally(graph).groupBy("piece").agg(((F.pow(F.sum(rows), 2) - F.sum(rows * rows)) / 2).alias("pairs"))
    return pieces.agg(F.sum("pairs")).first()[0] or 0.0


def _moves(graph: DataFrame, turn: int) -> DataFrame:
    """(unit, n, was, label) of the units of this ``turn`` that have more neighbours in another shard than in theirs, with that shard."""
    others = F.col("rows") - F.when(F.col("to") == F.col("label"), F.col("n")).otherwise(0)
    turns = F.pmod(_hash("unit", F.lit(turn)), F.lit(2)) == 0
    votes = graph.where(turns).join(_tally(graph), "piece").groupBy("unit", "n", "label", "to").agg(F.sum(others).alias("votes"))
    best = F.max(F.struct("votes", _hash("unit", "to").alias("tie"), "to")).alias("best")
    own = F.coalesce(F.max(F.when(F.col("to") == F.col("label"), F.col("votes"))), F.lit(0)).alias("own")
    found = votes.groupBy("unit", "n", "label").agg(best, own).where("best.to <> label and best.votes > own")
    return found.select("unit", "n", F.col("label").alias("was"), F.col("best.to").alias("label"))


def propagate(units: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Graph (unit, n, piece, label) of the linked ones of ``units`` (unit, n, pieces), those of several rows among them.

    A round joins the incidences with what their pieces' current labels tally to.
    """
    shared = _graph(units, max(1.0, 0.75 * max(1, quota[-1])))
    several = units.where("n > 1").select("unit", "n", F.col("unit").alias("piece"))  # linked within themselves
    start = F.pmod(_hash("unit", F.lit("start")), F.lit(len(quota))).cast("int")
    graph, still = cut(shared.union(several).withColumn("label", start)), 0
    once = graph.groupBy("unit", "n", "label").agg(F.lit(1)).groupBy("label").agg(F.sum("n").alias("rows"))
    load = {r["label"]: r["rows"] for r in once.collect()}  # a row a shard
    for turn in range(rounds):
        free = [max(0, q - load.get(s, 0)) for s, q in enumerate(quota)]
        new = cut(_accept(_moves(graph, turn), free))
        flows = new.groupBy("was", "label").agg(F.sum("n").alias("rows")).collect()  # at most a row for two shards
        still = 0 if flows else still + 1
        if still == 2:
            break
        for r in flows:
            load[r["was"]] -= r["rows"]
            load[r["label"]] = load.get(r["label"], 0) + r["rows"]
        if flows:
            graph = cut(graph.join(new.select("unit", F.col("label").alias("to")), "unit", "left").select("unit", "n", "piece", F.coalesce("to", "label").alias("label")))
    return graph


def units_of(rows: DataFrame, quota: list[int]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with their unit, units (unit, n, pieces)) for rows of ``sized``."""
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("group_n"))
    parts = F.ceil(F.col("group_n") / F.lit(max(1.0, 0.75 * max(1, quota[-1])))).cast("int")
    large = cut(groups.withColumn("parts", parts).where("parts > 1").select(*KEY, "parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(_hash("doc_id", F.lit("part")), F.col("parts"))).otherwise(0)
    rows = cut(rows.join(if_small(large), KEY, "left").withColumn("unit", _hash(*KEY, part)).drop("parts"))
    return rows, cut(rows.groupBy("unit").agg(F.count("*").alias("n"), F.first("pieces").alias("pieces")))


@shuffles_go
def shard_rows(rows: DataFrame, n_shards: int = 24) -> DataFrame:
    """``rows`` of ``sized`` (cut) with shard and slot, both of which are new columns."""
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rows, units = units_of(rows, quota)
    labels = propagate(units, quota).groupBy("unit").agg(F.max("n").alias("n"), F.max("label").alias("label"))
    placed = cut(_accept(labels, quota))
    filled = {r["label"]: r["rows"] for r in placed.groupBy("label").agg(F.sum("n").alias("rows")).collect()}
    free = [q - filled.get(s, 0) for s, q in enumerate(quota)]
    rows = rows.join(if_small(placed.select("unit", F.col("label").alias("shard")), 1_000_000), "unit", "left").drop("unit", "pieces")
    rest = _ranked(rows.where("shard is null").drop("shard"), [], "rank", total)
    ends = [sum(free[: s + 1]) for s in range(n_shards)]
    rest = rest.withColumn("shard", F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda e: e <= F.col("rank")))).drop("rank")
    full = cut(rows.where("shard is not null").select(*rest.columns).union(rest))
    return _ranked(full, ["shard"], "slot", total // n_shards)


@shuffles_go
def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """``docs`` (doc_id, text and any others) with shard and slot; equal texts share a shard as far as the law allows.

    A null text is linked with empty ones; a null doc_id is an id like others; an empty table
    stays empty. Repeated rows are dealt apart: each has a slot of its own. Columns named shard or
    slot are replaced, others stay, whatever their names.
    """
    plan = shard_rows(cut(sized(docs)), n_shards).withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", *KEY).orderBy("shard", "slot")))
    keys = ["doc_id", *KEY, "copy"]
    plan = plan.select(*[F.col(k).alias(f"plan_{k}") for k in keys], "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "text_hash": _hash(text)}
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", *[x.alias(k) for k, x in own.items()])  # one struct a row, so that no name clashes
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", *KEY).orderBy(F.lit(0))))
    on = F.col("doc_id").eqNullSafe(F.col("plan_doc_id"))
    for k in keys[1:]:
        on &= F.col(k) == F.col(f"plan_{k}")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(plan, on).select(*kept, "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``."""
    rows = shard_rows(cut(sized(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
