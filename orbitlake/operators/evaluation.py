"""Confusion counts, thresholds and paired comparisons over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions.contracts import not_empty
from orbitlake.sources.fixtures import SQL_SCORES, scores

BINS = 2000


def confusion(rows: DataFrame, by: list[str], pred: Column) -> DataFrame:
    """tp, fp, fn, tn by group; additive, so partial sums are combined."""
    gt = F.col("gt") == 1
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", pred & gt), ("fp", pred & ~gt), ("fn", ~pred & gt), ("tn", ~pred & ~gt))])


def _share(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def with_metrics(cm: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, iou and accuracy; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cm.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn), "iou": _share(tp, tp + fp + fn), "accuracy": _share(tp + tn, tp + fp + fn + tn)})


def histogram(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(model, bin, pos, neg) over [0, 1]; the last bin holds 1 as well."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy("model", at.alias("bin")).agg(F.count_if(F.col("gt") == 1).alias("pos"), F.count_if(F.col("gt") == 0).alias("neg"))


def curve(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts at 199 thresholds 0.005 to 0.995 from at most ``bins`` rows a model. Reading it fails without any rows."""
    hist = not_empty(hist, "no scores to calibrate with")
    taus = hist.select("model").distinct().select("model", F.explode(F.sequence(F.lit(1), F.lit(199))).alias("i"))
    cut_ = (F.col("i") * bins / 200).cast("int")
    above = hist.join(taus, "model").groupBy("model", "i").agg(F.sum(F.when(F.col("bin") >= cut_, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") >= cut_, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return with_metrics(above.select("model", F.round(F.col("i") * 5 / 1000, 3).alias("tau"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn")))


def first_best(rows: DataFrame, by: list[str]) -> DataFrame:
    """Highest f1, smallest threshold on ties."""
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), "tau")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def per_scene(spark: SparkSession, d: str) -> DataFrame:
    return confusion(scores(spark, d), ["model", "scene_id"], F.col("score") >= F.when(F.col("model") == "a", 0.41).otherwise(0.7))


def d5_confusion(spark: SparkSession, d: str) -> DataFrame:
    return with_metrics(confusion(scores(spark, d), ["model"], F.col("score") >= 0.41))


def d29_per_scene(spark: SparkSession, d: str) -> DataFrame:
    return with_metrics(per_scene(spark, d))


def d7_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(scores(spark, d))


def d8_curve(spark: SparkSession, d: str) -> DataFrame:
    return curve(histogram(scores(spark, d)))


def d8_calibrated(spark: SparkSession, d: str) -> DataFrame:
    return first_best(curve(histogram(scores(spark, d))), ["model"])


def d10_grid(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts at 19 thresholds: every score is compared with all of them in one pass."""
    rows = scores(spark, d).select("model", "gt", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("i"), "score").withColumn("tau", F.round(F.col("i") / 20, 2))
    return first_best(with_metrics(confusion(rows, ["model", "tau"], F.col("score") >= F.col("tau"))), ["model"])


def d26_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Models must be judged on the same items: one total and one number of positives a scene."""
    cm = per_scene(spark, d)
    return cm.groupBy("scene_id").agg((F.count_distinct(F.expr("tp + fp + fn + tn")) == 1).alias("same_total"), (F.count_distinct(F.expr("tp + fn")) == 1).alias("same_positives"))


def _sh(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END, 6)"


METRICS = f"{_sh('tp', 'tp + fp')} AS precision, {_sh('tp', 'tp + fn')} AS recall, {_sh('2 * tp', '2 * tp + fp + fn')} AS f1, {_sh('tp', 'tp + fp + fn')} AS iou, {_sh('tp + tn', 'tp + fp + fn + tn')} AS accuracy"


def _cm(by: str, pred: str, rows: str = "scores") -> str:
    return f"SELECT {by}, count(*) FILTER ({pred} AND gt = 1) AS tp, count(*) FILTER ({pred} AND gt = 0) AS fp, count(*) FILTER (NOT ({pred}) AND gt = 1) AS fn, count(*) FILTER (NOT ({pred}) AND gt = 0) AS tn FROM {rows} GROUP BY ALL"


SCENES = _cm("model, scene_id", "score >= CASE WHEN model = 'a' THEN 0.41::DOUBLE ELSE 0.7::DOUBLE END")
MS = f"WITH {SQL_SCORES}, cm AS ({SCENES}), m AS (SELECT *, {METRICS} FROM cm) "
HIST = "SELECT model, least(floor(score * 2000), 1999)::INT AS bin, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 0) AS neg FROM scores GROUP BY ALL"
CURVE = f"""WITH {SQL_SCORES}, h AS ({HIST}), c AS (SELECT model, i, sum(CASE WHEN bin >= i * 10 THEN pos ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN bin >= i * 10 THEN neg ELSE 0 END)::BIGINT AS fp, sum(pos)::BIGINT AS p, sum(neg)::BIGINT AS n FROM h, range(1, 200) t(i) GROUP BY ALL),
cv AS (SELECT *, {METRICS} FROM (SELECT model, round(i * 5 / 1000, 3) AS tau, tp, fp, p - tp AS fn, n - fp AS tn FROM c)) """
BEST = "SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, tau) = 1"
QUERIES = {f.__name__: f for f in (d5_confusion, d7_histogram, d8_curve, d8_calibrated, d10_grid, d26_accounting, d29_per_scene)}
SQL = {
    "d5_confusion": f"WITH {SQL_SCORES}, cm AS ({_cm('model', 'score >= 0.41::DOUBLE')}) SELECT *, {METRICS} FROM cm",
    "d29_per_scene": MS + "SELECT * FROM m",
    "d7_histogram": f"WITH {SQL_SCORES} {HIST}",
    "d8_curve": CURVE + "SELECT * FROM cv",
    "d8_calibrated": CURVE + BEST.format("cv"),
    "d10_grid": f"WITH {SQL_SCORES}, g AS (SELECT scores.*, round(i / 20, 2) AS tau FROM scores, range(1, 20) t(i)), cm AS ({_cm('model, tau', 'score >= tau', 'g')}), m AS (SELECT *, {METRICS} FROM cm) " + BEST.format("m"),
    "d26_accounting": MS + "SELECT scene_id, count(DISTINCT tp + fp + fn + tn) = 1 AS same_total, count(DISTINCT tp + fn) = 1 AS same_positives FROM m GROUP BY ALL",
}
