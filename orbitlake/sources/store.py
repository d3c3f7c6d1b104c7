"""Vectors on disk with what they were made from, one fingerprint over all ids, and a check of both before they are used."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions.lineage import cut
from orbitlake.operators.text_search import earlier

#: Children of a node of the hash tree, and its levels: a root for up to FANOUT ** LEVELS ids.
FANOUT, LEVELS = 1000, 4
#: What a store has to agree in, in the order in which it is looked at.
FIELDS = ("model", "dataset", "split", "count", "dim", "root")


def fingerprint(ids: DataFrame) -> DataFrame:
    """One row (count, root) for (pos, id), pos from 0 without gaps: a hash that each id, its place and their number change.

    A leaf hashes FANOUT neighbouring ids with their lengths, a node the hashes of FANOUT neighbours below; so
    no task sees more than FANOUT of either at a time.
    """
    text = F.col("id").cast("string")
    now = ids.select("pos", F.concat(F.octet_length(text).cast("string"), F.lit(":"), text).alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(LEVELS):
        below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "")
        now = now.groupBy(F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.sha2(below, 256).alias("h"), F.sum("n").alias("n"))
    empty = ids.sparkSession.range(1).select(F.lit(0).cast("long").alias("none"))
    root = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.max("h").alias("h"))  # one row
    return root.crossJoin(F.broadcast(empty)).select("count", F.sha2(F.concat(F.col("count").cast("string"), F.lit(":"), F.coalesce("h", F.lit(""))), 256).alias("root"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """(pos, id) of distinct numbers in ascending order."""
    return earlier(cut(rows.select(key)), key).select(F.col("before").alias("pos"), F.col(key).alias("id"))


def described(rows: DataFrame, ids: DataFrame, model: str, dataset: str, split: str) -> DataFrame:
    """One row of FIELDS for vectors (id, vector) of the ids (pos, id): dim is null where vectors differ in it."""
    sizes = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"))
    of = fingerprint(ids).crossJoin(F.broadcast(sizes))  # a row each
    return of.select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "count", F.when(F.col("a") == F.col("b"), F.col("a").cast("long")).alias("dim"), "root")


def mismatch(there: str, wanted: str) -> Column:
    """The first of FIELDS that differs between the structs of two columns, or null; a field that isn't expected (null) agrees with all."""
    return F.coalesce(*[F.when(F.col(f"{wanted}.{f}").isNotNull() & ~F.col(f"{wanted}.{f}").eqNullSafe(F.col(f"{there}.{f}")), F.lit(f"{f} mismatch")) for f in FIELDS])


def write_store(rows: DataFrame, path: str, model: str, dataset: str, split: str) -> None:
    """Vectors (pos, id, vector) as float32 under ``path``, and what describes them. Vectors of several sizes are an error."""
    about = cut(described(rows, rows.select("pos", "id"), model, dataset, split))
    if about.where("count > 0 AND dim IS NULL").head(1):
        raise ValueError("vectors differ in their sizes")
    rows.select("pos", "id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    about.write.mode("overwrite").json(f"{path}/about")


def store_state(spark: SparkSession, path: str, model: str, dataset: str, split: str, count: int | None = None, dim: int | None = None, ids: DataFrame | None = None) -> str | None:
    """Why the store at ``path`` isn't that of the arguments, or None if it is: 'absent', or the first field that differs.

    ``ids`` (pos, id) are those that it should hold, in their order. The vectors on disk are compared with what is
    said of them as well.
    """
    try:
        about = spark.read.schema("model string, dataset string, split string, count long, dim long, root string").json(f"{path}/about")
        rows = spark.read.parquet(f"{path}/vectors")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return "absent"
    held = described(rows, rows.select("pos", "id"), model, dataset, split)
    wanted = held.select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(count).cast("long").alias("count"), F.lit(dim).cast("long").alias("dim"), F.lit(None).cast("string").alias("root"))
    if ids is not None:
        expected = fingerprint(ids)
        wanted = wanted.drop("count", "root").crossJoin(F.broadcast(expected.select(F.coalesce(F.lit(count).cast("long"), "count").alias("count"), "root")))
    pack = lambda df, name: df.select(F.struct(*FIELDS).alias(name))
    found = pack(about, "about").crossJoin(F.broadcast(pack(wanted, "wanted"))).crossJoin(F.broadcast(pack(held, "held")))  # a row each
    row = found.select(F.coalesce(mismatch("about", "wanted"), F.concat(F.lit("stored "), mismatch("held", "about"))).alias("why")).first()
    return "absent" if row is None else row["why"]


def read_store(spark: SparkSession, path: str, **expected) -> DataFrame:
    """The vectors (pos, id, vector) at ``path``; a store that isn't the one of ``expected`` (see store_state) is an error."""
    why = store_state(spark, path, **expected)
    if why:
        raise ValueError(f"the store at {path} is refused: {why}")
    return spark.read.parquet(f"{path}/vectors")
