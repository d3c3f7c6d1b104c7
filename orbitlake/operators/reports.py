"""Comparisons of models and alignment gates; texts for DuckDB stand apart from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.operators.evaluation import MS, per_scene, with_metrics
from orbitlake.sources.fixtures import table

# weights and bounds of the alignment gate, in SQL
CONFIDENCE = (
    "round((3.5e-1 * least(1e0, greatest(0e0, ratio)) + 3.5e-1 * least(1e0, greatest(0e0, coverage)) + 3e-1 * least(1e0, greatest(0e0, 1e0 - error / 5e0)))"
    " * least(1e0, greatest(1e-1, inliers / 4e1)), 8)"
)
GATE = "CASE WHEN matches < 15 THEN 'rejected' WHEN score >= 6.5e-1 AND inliers >= 10 THEN 'aligned' WHEN score >= 2.5e-1 OR (inliers >= 8 AND error <= 4e0) THEN 'moderate' ELSE 'rejected' END"
DIAGNOSTICS = ["o_orderkey", "o_custkey % 60 AS matches", "o_orderkey % 45 AS inliers", "o_orderkey % 11 / 1e1 AS ratio", "o_orderkey % 50 / 1e1 AS error", "o_orderkey % 101 / 1e2 AS coverage"]


def _guarded(a: str, b: str, empty: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a}) * 1e0 / ({b}) ELSE {empty} END, 6)"


#: Without predictions precision is 1, without positives recall is 1, without either the overlap is 1.
OPTIMISTIC = {"precision": _guarded("tp", "tp + fp", "1e0"), "recall": _guarded("tp", "tp + fn", "1e0"), "iou": _guarded("tp", "tp + fp + fn", "1e0")}


def optimistic() -> dict[str, Column]:
    """Precision, recall and overlap that are 1 where there is nothing to get wrong."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return {n: F.round(F.when(of > 0, tp / of).otherwise(1.0), 6) for n, of in (("precision", tp + fp), ("recall", tp + fn), ("iou", tp + fp + fn))}


# fixed values: shares of inliers, coverage and error in the confidence of an alignment, and what it takes to pass
SHARES, MOST_ERROR, MANY_INLIERS = (0.35, 0.35, 0.3), 5.0, 40
FEWEST_MATCHES, ALIGNED, ALIGNED_INLIERS, MODERATE, MODERATE_INLIERS, MODERATE_ERROR = 15, 0.65, 10, 0.25, 8, 4.0


def confidence(ratio: Column, coverage: Column, error: Column, inliers: Column) -> Column:
    held = lambda v, low=0.0: F.least(F.lit(1.0), F.greatest(F.lit(low), v))
    parts = zip(SHARES, (ratio, coverage, 1 - error / MOST_ERROR), strict=True)
    total = sum((held(v) * w for w, v in parts), F.lit(0.0))
    return F.round(total * held(inliers / MANY_INLIERS, 0.1), 8)


def gate(matches: Column, inliers: Column, error: Column, score: Column, identical: Column | None = None) -> Column:
    """identity for identical pairs, else rejected, aligned, moderate or rejected, by the first rule that holds."""
    passed = F.when(matches < FEWEST_MATCHES, "rejected").when((score >= ALIGNED) & (inliers >= ALIGNED_INLIERS), "aligned")
    passed = passed.when((score >= MODERATE) | ((inliers >= MODERATE_INLIERS) & (error <= MODERATE_ERROR)), "moderate").otherwise("rejected")
    return passed if identical is None else F.when(identical, "identity").otherwise(passed)


def warnings(matches: Column, status: Column) -> Column:
    """What is to be said of an alignment, in order."""
    said = [F.when(matches < FEWEST_MATCHES, "too few matches"), F.when(status == "moderate", "alignment is moderate"), F.when((status == "rejected") & (matches >= FEWEST_MATCHES), "alignment is not reliable")]
    return F.filter(F.array(*said), lambda w: w.isNotNull())


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, (F.col("o_custkey") % 60).alias("matches"), (k % 45).alias("inliers"), (k % 11 / 10).alias("ratio"), (k % 50 / 10).alias("error"), (k % 101 / 100).alias("coverage"))
    return rows.withColumn("score", confidence(F.col("ratio"), F.col("coverage"), F.col("error"), F.col("inliers")))


def d6b_optimistic(spark: SparkSession, d: str) -> DataFrame:
    return per_scene(spark, d).select("model", "scene_id", *[c.alias(n) for n, c in optimistic().items()])


def c8_paired(spark: SparkSession, d: str) -> DataFrame:
    """Both models' f1 of each scene and which is better."""
    m = with_metrics(per_scene(spark, d))
    a, b = (m.where(F.col("model") == x).select("scene_id", F.col("f1").alias(f"f1_{x}")) for x in "ab")
    return a.join(b, "scene_id").selectExpr("scene_id", "f1_a", "f1_b", "CASE WHEN f1_a > f1_b THEN 'a' WHEN f1_b > f1_a THEN 'b' ELSE 'tie' END AS better")


def m1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics(spark, d).select("o_orderkey", "score")


def m2_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by outcome of the alignment gate, with how many warnings they bear; pairs without error over the whole image count as identical."""
    of = [F.col(c) for c in ("matches", "inliers", "error", "score")]
    same = (F.col("error") == 0) & (F.col("coverage") >= 0.9)
    rows = diagnostics(spark, d).withColumn("outcome", gate(*of, same)).withColumn("score", F.when(F.col("outcome") == "identity", 1.0).otherwise(F.col("score")))
    rows = rows.withColumn("warned", F.size(warnings(F.col("matches"), F.col("outcome"))))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("warned").alias("warnings"))


DIAG = "WITH d AS (SELECT " + ", ".join(DIAGNOSTICS) + f" FROM orders), s AS (SELECT *, {CONFIDENCE} AS score FROM d) "
QUERIES = {f.__name__: f for f in (d6b_optimistic, c8_paired, m1_confidence, m2_gate)}
SQL = {
    "d6b_optimistic": MS + "SELECT model, scene_id, " + ", ".join(f"{e} AS {n}" for n, e in OPTIMISTIC.items()) + " FROM cm",
    "c8_paired": MS + "SELECT a.scene_id, a.f1 AS f1_a, b.f1 AS f1_b, CASE WHEN a.f1 > b.f1 THEN 'a' WHEN b.f1 > a.f1 THEN 'b' ELSE 'tie' END AS better FROM m a JOIN m b ON a.scene_id = b.scene_id AND a.model = 'a' AND b.model = 'b'",
    "m1_confidence": DIAG + "SELECT o_orderkey, score FROM s",
    "m2_gate": DIAG + f", g AS (SELECT *, CASE WHEN error = 0 AND coverage >= 9e-1 THEN 'identity' ELSE {GATE} END AS outcome FROM s) SELECT outcome, count(*) AS n, min(CASE WHEN outcome = 'identity' THEN 1 ELSE score END) AS lo, max(CASE WHEN outcome = 'identity' THEN 1 ELSE score END) AS hi, sum(CASE WHEN outcome = 'identity' THEN (matches < 15)::INT WHEN matches < 15 OR outcome IN ('moderate', 'rejected') THEN 1 ELSE 0 END)::BIGINT AS warnings FROM g GROUP BY outcome",
}
