"""Exact vector search in blocks, ensembles and checks of vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions.lineage import cut
from orbitlake.sources import store
from orbitlake.sources.fixtures import table

#: Vectors of a block; a task multiplies one block of queries with one of the gallery at a time.
BLOCK = 1024


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def unit(v: str) -> Column:
    """The vector over its length; a zero vector as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def normalized(vectors: DataFrame) -> DataFrame:
    """All vectors over their lengths (and 1e-9), if any length is off one by more than 1e-3; else as they are."""
    off = vectors.agg(F.coalesce(F.max(F.abs(norm("embedding") - 1)), F.lit(0.0)).alias("_off"))  # one row
    rows = vectors.crossJoin(F.broadcast(off)).withColumn("_norm", norm("embedding") + 1e-9)
    scaled = F.transform("embedding", lambda x: F.when(F.col("_off") > 1e-3, x.cast("double") / F.col("_norm")).otherwise(x.cast("double")))
    return rows.withColumn("embedding", scaled).drop("_off", "_norm")


def blocks(vectors: DataFrame, prefix: str) -> DataFrame:
    """(``prefix``_ids, ``prefix``_flat): unit vectors dealt by a hash of their ids into blocks of about BLOCK, ids ascending."""
    n = max(1, -(-vectors.count() // BLOCK))
    rows = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), F.struct("vec_id", unit("embedding").alias("u")).alias("row"))
    packed = rows.groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return packed.select(F.col("rows.vec_id").alias(f"{prefix}_ids"), F.flatten("rows.u").alias(f"{prefix}_flat"))


def _nearest(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q, g = (np.asarray(x).reshape(len(i), -1) for i, x in ((row.q_ids, row.q_flat), (row.g_ids, row.g_flat)))
                score = np.round(q @ g.T, 9)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller
                yield pd.DataFrame({"query": np.repeat(row.q_ids, best.shape[1]), "vec_id": np.asarray(row.g_ids)[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    return run


def search(queries: DataFrame, gallery: DataFrame, k: int = 10) -> DataFrame:
    """(query, vec_id, score, rank): the k largest inner products of unit vectors, ties to the smaller id."""
    conf = gallery.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    pairs = blocks(gallery, "g").crossJoin(blocks(queries, "q"))
    found = pairs.mapInPandas(_nearest(k), "query long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ahead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query of a block, how many vectors of a gallery block come before its target."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            q, g = (np.asarray(x).reshape(len(i), -1) for i, x in ((row.q_ids, row.q_flat), (row.g_ids, row.g_flat)))
            score, ids = np.round(q @ g.T, 9), np.asarray(row.g_ids)
            target, s = np.asarray(row.q_targets)[:, None], np.asarray(row.q_scores)[:, None]
            ahead = (ids != target) & ((score > s) | ((score == s) & (ids < target)))
            yield pd.DataFrame({"query": row.q_ids, "ahead": ahead.sum(axis=1)})


def target_ranks(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(query, target, score, rank): the place of each query's target in the order of the whole gallery, ties to the smaller id.

    ``queries`` has vec_id, embedding and target, the id of a gallery vector; queries whose target
    is not in the gallery are left out. Counts of the vectors ahead are summed over blocks, so
    that the order itself is never written.
    """
    conf = gallery.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    own = gallery.select(F.col("vec_id").alias("target"), unit("embedding").alias("t"))
    dot = F.aggregate(F.zip_with("u", "t", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = queries.select("vec_id", "target", unit("embedding").alias("u")).join(own, "target").select("vec_id", "target", "u", F.round(dot, 9).alias("s"))
    n = max(1, -(-queries.count() // BLOCK))
    packed = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("vec_id", "target", "u", "s")).alias("rows"))
    packed = packed.select(F.col("rows.vec_id").alias("q_ids"), F.col("rows.target").alias("q_targets"), F.col("rows.s").alias("q_scores"), F.flatten("rows.u").alias("q_flat"))
    ahead = blocks(gallery, "g").crossJoin(packed).mapInPandas(_ahead, "query long, ahead long").groupBy("query").agg(F.sum("ahead").alias("ahead"))
    return rows.select(F.col("vec_id").alias("query"), "target", F.col("s").alias("score")).join(ahead, "query").select("query", "target", "score", (F.col("ahead") + 1).alias("rank"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _found(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).select("vec_id", "embedding")
    return search(rows.where("vec_id % 20 = 0"), rows)


def i1_norms(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).select("vec_id", F.round(norm("embedding"), 6).alias("norm"), F.round(F.element_at(unit("embedding"), 1), 6).alias("first"))


def i2_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest of all vectors for every vector whose id is divisible by 20."""
    return _found(spark, d).select("query", "vec_id", F.round("score", 4).alias("score"), "rank")


def i3_label_precision(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten nearest, the query itself left out, bear the query's label."""
    labels = _embeddings(spark, d).select("vec_id", "label")
    found = _found(spark, d).where("query <> vec_id").join(labels, "vec_id").join(labels.toDF("query", "own"), "query")
    return found.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("own")).alias("hits"))


def i3_target_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Where the next vector by id stands among all, for every vector whose id is divisible by 20."""
    rows = _embeddings(spark, d).select("vec_id", "embedding")
    found = target_ranks(rows.where("vec_id % 20 = 0").withColumn("target", F.col("vec_id") + 1), rows)
    return found.select("query", "target", F.round("score", 4).alias("score"), "rank")


def i4_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the unit vectors of each five ids in a row, brought to length one; a row a component."""
    parts = _embeddings(spark, d).select(F.floor(F.col("vec_id") / 5).alias("grp"), F.posexplode(unit("embedding")).alias("pos", "x"))
    mean = parts.groupBy("grp", "pos").agg(F.avg("x").alias("x"))
    size = mean.groupBy("grp").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return mean.join(size, "grp").select("grp", "pos", F.round(F.when(F.col("size") > 0, F.col("x") / F.col("size")).otherwise(F.col("x")), 6).alias("x"))


def i5_checks(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.count_if(F.size("embedding") != 64).alias("wrong_size"))


def i6_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the ids of each block of 1000, in order; a cached copy is valid where all agree."""
    ids = F.array_join(F.array_sort(F.collect_list("vec_id")).cast("array<string>"), ",")
    return _embeddings(spark, d).groupBy(F.floor(F.col("vec_id") / 1000).alias("block")).agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("fingerprint"))


def i6_root(spark: SparkSession, d: str) -> DataFrame:
    """One fingerprint of all ids in their order."""
    return store.fingerprint(store.numbered(_embeddings(spark, d), "vec_id"))


def i6_cache_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether the vectors are those that several runs expect: the same, another model or size, ids less one, ids in another order."""
    rows = _embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ids = cut(store.numbered(rows, "id"))
    about = store.described(rows, ids, "m", "d", "test")
    last = ids.agg(F.max("pos").alias("last"))  # one row
    roots = {"same": ids, "less_one": ids.crossJoin(F.broadcast(last)).where("pos < last").drop("last"), "other_order": ids.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("pos")).alias("pos"), "id")}
    cases = [("same", "m", 64, "same"), ("other_model", "n", 64, "same"), ("other_dim", "m", 65, "same"), ("less_one", "m", 64, "less_one"), ("other_order", "m", 64, "other_order")]
    wanted = None
    for name, model, dim, of in cases:
        one = store.fingerprint(roots[of]).select(F.lit(name).alias("variant"), F.struct(F.lit(model).alias("model"), F.lit("d").alias("dataset"), F.lit("test").alias("split"), "count", F.lit(dim).cast("long").alias("dim"), "root").alias("wanted"))
        wanted = one if wanted is None else wanted.unionByName(one)
    found = wanted.crossJoin(F.broadcast(about.select(F.struct(*store.FIELDS).alias("about"))))
    why = store.mismatch("about", "wanted")
    return found.select("variant", why.isNull().alias("valid"), why.alias("reason"))


def i1_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as they are and doubled: only the latter are brought to length one, as their lengths are off."""
    rows = _embeddings(spark, d)
    out = None
    for by in (1, 2):
        found = normalized(rows.withColumn("embedding", F.transform("embedding", lambda x: x * by)))  # noqa: B023
        one = found.select("vec_id", F.lit(by).alias("factor"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(norm("embedding"), 4).alias("norm"))
        out = one if out is None else out.unionByName(one)
    return out


def i7_index_size(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).agg(F.sum(F.size("embedding").cast("long") * 4).alias("bytes"))


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
UNIT = f"list_transform(embedding, lambda x: x::DOUBLE / {NORM})"
FOUND = f"""WITH u AS (SELECT vec_id, label, {UNIT} AS u FROM embeddings),
s AS (SELECT q.vec_id AS query, q.label AS own, g.vec_id, g.label, round(list_inner_product(q.u, g.u), 9) AS score FROM u q, u g WHERE q.vec_id % 20 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10) """


def _root(ids: str) -> str:
    """(count, root) of (pos, id) by four levels of thousands."""
    levels = f"SELECT pos // 1000 AS pos, sha256(string_agg(strlen(id::VARCHAR) || ':' || id, '' ORDER BY pos)) AS h FROM ({ids}) GROUP BY 1"
    for _ in range(3):
        levels = f"SELECT pos // 1000 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM ({levels}) GROUP BY 1"
    return f"SELECT (SELECT count(*) FROM ({ids})) AS count, sha256((SELECT count(*) FROM ({ids})) || ':' || coalesce((SELECT max(h) FROM ({levels})), '')) AS root"


_IDS = "SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings"
_CASES = {"same": ("m", 64, _IDS), "other_model": ("n", 64, _IDS), "other_dim": ("m", 65, _IDS), "less_one": ("m", 64, f"SELECT * FROM ({_IDS}) WHERE pos < (SELECT count(*) - 1 FROM embeddings)"), "other_order": ("m", 64, "SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS pos FROM embeddings")}
QUERIES = {f.__name__: f for f in (i1_norms, i2_vector_search, i3_label_precision, i3_target_ranks, i4_ensemble, i5_checks, i1_normalized, i6_fingerprints, i6_root, i6_cache_valid, i7_index_size)}
SQL = {
    "i1_norms": f"SELECT vec_id, round({NORM}, 6) AS norm, round(({UNIT})[1], 6) AS first FROM embeddings",
    "i2_vector_search": FOUND + "SELECT query, vec_id, round(score, 4) AS score, rank FROM f",
    "i3_label_precision": FOUND + "SELECT own AS label, count(*) AS n, count(*) FILTER (label = own) AS hits FROM f WHERE query <> vec_id GROUP BY own",
    "i3_target_ranks": FOUND[: FOUND.index(",\nf AS")] + ", t AS (SELECT query, vec_id AS target, score AS s FROM s WHERE vec_id = query + 1) SELECT query, target, round(any_value(t.s), 4) AS score, 1 + count(*) FILTER (s.vec_id <> target AND (s.score > t.s OR s.score = t.s AND s.vec_id < target)) AS rank FROM s JOIN t USING (query) GROUP BY query, target",
    "i4_ensemble": f"WITH u AS (SELECT vec_id // 5 AS grp, unnest(range(64))::INT AS pos, unnest({UNIT}) AS x FROM embeddings), m AS (SELECT grp, pos, avg(x) AS x FROM u GROUP BY ALL) SELECT grp, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY grp)), 6) AS x FROM m",
    "i5_checks": "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, count(*) FILTER (len(embedding) <> 64) AS wrong_size FROM embeddings",
    "i6_fingerprints": "SELECT vec_id // 1000 AS block, count(*) AS n, sha256(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS fingerprint FROM embeddings GROUP BY ALL",
    "i6_root": _root(_IDS),
    "i6_cache_valid": f"WITH a AS (SELECT *, (SELECT max(len(embedding)) FROM embeddings) AS dim FROM ({_root(_IDS)})), w AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, '{m}' AS model, {k} AS dim, * FROM ({_root(ids)})" for n, (m, k, ids) in _CASES.items()) + "), r AS (SELECT variant, CASE WHEN w.model <> 'm' THEN 'model mismatch' WHEN w.count <> a.count THEN 'count mismatch' WHEN w.dim <> a.dim THEN 'dim mismatch' WHEN w.root <> a.root THEN 'root mismatch' END AS reason FROM w, a) SELECT variant, reason IS NULL AS valid, reason FROM r",
    "i1_normalized": f"SELECT vec_id, factor, round(CASE WHEN factor = 2 THEN embedding[1]::DOUBLE * 2 / (2 * {NORM} + 1e-9) ELSE embedding[1]::DOUBLE END, 6) AS first, round(CASE WHEN factor = 2 THEN 1 ELSE {NORM} END, 4) AS norm FROM embeddings, (SELECT unnest([1, 2]) AS factor)",
    "i7_index_size": "SELECT sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings",
}
