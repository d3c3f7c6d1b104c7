"""Paired tests, resampling, exact quantiles and comparisons of models, at any number of scenes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions.lineage import cut
from orbitlake.operators.evaluation import METRICS, MS, confusion, per_scene, with_metrics
from orbitlake.operators.text_search import earlier
from orbitlake.sources.fixtures import SQL_SCORES, scores, table

#: Pairs with differences up to which the null distribution is counted out.
EXACT_PAIRS = 25
#: Scenes and draws that a task resamples, and draws whose numbers are in memory at a time.
SCENES_A_CELL, DRAWS_A_CELL, DRAWN = 50_000, 125, 1 << 20
#: Bins that a range is cut into each time.
BINS = 256
PRIME = 2_147_483_647


def null_tail(doubled_ranks: list[int], doubled: int) -> float:
    """Twice the chance that random signs give a sum of (doubled) ranks of at most ``doubled``, at most 1."""
    ways = np.zeros(sum(doubled_ranks) + 1)
    ways[0] = 1
    for r in doubled_ranks:
        ways[r:] += ways[: len(ways) - r].copy()
    return min(1.0, 2 * float(ways[: doubled + 1].sum()) / 2.0 ** len(doubled_ranks))


def _p_values(n: pd.Series, statistic: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
    out = []
    for pairs, w, deviate, sizes in zip(n, statistic, z, ties, strict=True):
        if pairs == 0:
            out.append(1.0)
        elif pairs <= EXACT_PAIRS:
            ranks, before = [], 0
            for t in sizes:
                ranks += [2 * before + int(t) + 1] * int(t)
                before += int(t)
            out.append(null_tail(ranks, round(2 * w)))
        else:
            out.append(math.erfc(abs(deviate) / math.sqrt(2)))
    return pd.Series(out)


def paired_tests(scenes: DataFrame, pairs: list[tuple[str, str]], metrics: tuple[str, ...] = ("f1", "iou"), level: float = 0.05) -> DataFrame:
    """Signed-rank tests of ``scenes`` (scene_id, model, metrics) between two models, for each of ``pairs`` and ``metrics``.

    Scenes that both models have count. Equal values are dropped, ties take mean ranks; the statistic is
    the smaller rank sum, the probability two-sided: exact up to EXACT_PAIRS pairs that differ, else by the normal with the
    variance that ties leave. Without a difference the statistic is 0 and the probability 1. Differences count to 6
    decimals, so that ranks come from at most a million sizes and their counts, however many scenes there are.
    """
    long = scenes.unpivot(["scene_id", "model"], list(metrics), "metric", "v")
    wanted = long.sparkSession.createDataFrame(pairs, "model_a string, model_b string")
    a, b = (long.select("scene_id", "metric", F.col("model").alias(f"model_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    both = a.join(F.broadcast(wanted), "model_a").join(b, ["scene_id", "metric", "model_b"])  # a row a pair of models
    by = ["model_a", "model_b", "metric"]
    whole = both.groupBy(*by).agg(F.count("*").alias("n_scenes"), *[F.round(F.avg(f"v_{x}"), 6).alias(f"mean_{x}") for x in "ab"], F.round(F.avg(F.col("v_a") - F.col("v_b")), 6).alias("delta_mean"))
    diff = both.select(*by, F.round(F.col("v_a") - F.col("v_b"), 6).alias("d")).where("d <> 0")
    sizes = diff.groupBy(*by, F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("plus"), F.count("*").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("before", before).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    first = F.array_sort(F.collect_list(F.when(F.col("before") < EXACT_PAIRS, F.struct("before", "t"))))
    sums = ranked.groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("t") - F.col("plus")) * F.col("rank")).alias("w_minus"),
        F.sum(F.col("t").cast("double") * (F.col("t") * F.col("t") - 1)).alias("tied"), first["t"].alias("ties"),
    )
    out = whole.join(sums, by, "left").fillna(0, ["n", "w_plus", "w_minus", "tied"]).withColumn("statistic", F.least("w_plus", "w_minus"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    out = out.withColumn("z", F.when(spread > 0, (F.col("statistic") - n * (n + 1) / 4) / spread).otherwise(0.0))
    out = out.withColumn("p_value", F.pandas_udf(_p_values, "double")("n", "statistic", "z", "ties"))
    return out.withColumns({"z": F.round("z", 6), "p_value": F.round("p_value", 6), "significant": F.col("p_value") < level}).drop("tied", "ties")


def drawn(rep: np.ndarray | int, i: np.ndarray, n: int) -> np.ndarray:
    """The scene that draw ``i`` of repetition ``rep`` takes, of ``n``; whole numbers mixed by squares modulo a prime."""
    x = (rep * 1_000_003 + i * 7_919 + 104_729) % PRIME
    x = ((x * x + 12_345) % PRIME * 48_271 + i) % PRIME
    return (x * x + rep) % PRIME % n


def bootstrap(scenes: DataFrame, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """Mean and interval of precision, recall, F1, IoU (of summed counts) and macro F1 over resampled scenes, by model.

    ``scenes``: (model, scene_id, tp, fp, fn, f1), a row a model and scene. A repetition draws as many scenes as there
    are, the same for all models; what a model lacks counts nothing. Each task takes a range of scenes and some repetitions
    and adds up counts times draws as vectors; no draw is a row.
    """
    order = cut(earlier(scenes.select("scene_id").distinct(), "scene_id"))
    total = order.count()

    def resampled(key: tuple, rows: pa.Table) -> pa.Table:
        _, part, some = (k.as_py() for k in key)
        values = np.stack([rows[c].to_numpy().astype(np.float64) for c in ("tp", "fp", "fn", "f1")] + [np.ones(len(rows))], axis=1)
        place, first = rows["before"].to_numpy() - part * SCENES_A_CELL, part * SCENES_A_CELL
        reps, out = np.arange(some * DRAWS_A_CELL, min(draws, (some + 1) * DRAWS_A_CELL)), []
        for rep in reps.tolist():
            times = np.zeros(SCENES_A_CELL, np.int64)
            for i in range(0, total, DRAWN):
                at = drawn(rep, np.arange(i, min(total, i + DRAWN)), total) - first
                times += np.bincount(at[(at >= 0) & (at < SCENES_A_CELL)], minlength=SCENES_A_CELL)
            out.append(times[place] @ values)
        sums = np.array(out)
        return pa.table({"model": pa.array([rows["model"][0].as_py()] * len(reps)), "rep": reps, **{c: sums[:, j] for j, c in enumerate(("tp", "fp", "fn", "f1", "times"))}})

    cells = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_A_CELL)))
    rows = scenes.join(order, "scene_id").select("model", F.floor(F.col("before") / SCENES_A_CELL).alias("part"), cells.alias("some"), "before", "tp", "fp", "fn", "f1")
    sums = rows.groupBy("model", "part", "some").applyInArrow(resampled, "model string, rep long, tp double, fp double, fn double, f1 double, times double")
    sums = sums.groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "f1", "times")])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    shares = {"precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn), "iou": (tp, tp + fp + fn), "macro_f1": (F.col("f1"), F.col("times"))}
    found = sums.select("model", *[F.when(of > 0, a / of).otherwise(0.0).alias(name) for name, (a, of) in shares.items()])
    low = (1 - level) / 2
    bounds = [F.round(F.percentile("v", q), 6).alias(name) for name, q in (("lo", low), ("hi", 1 - low))]  # a value a repetition
    return found.unpivot("model", list(shares), "metric", "v").groupBy("model", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), *bounds)


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(``by``, share, v): quantiles of ``value`` as its sorted values have them, between two of them in proportion; nulls don't count.

    Each wanted value lies in a range that a pass cuts into BINS; what is left of it is from the smallest to the largest
    value of its bin, until these are equal. No task holds the values of a group.
    """
    rows = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).dropna()
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.col("share") * (F.col("n") - 1)
    two = F.array(*[F.struct(f(at).cast("long").alias("k"), F.lit(i).alias("upper")) for i, f in enumerate((F.floor, F.ceil))])
    open_ = ends.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("x", F.explode(two))
    open_ = cut(open_.select("g", "share", (at - F.floor(at)).alias("part"), "x.upper", "x.k", "lo", "hi"))
    done = []
    while True:
        done.append(open_.where("lo = hi").select("g", "share", "part", "upper", F.col("lo").alias("v")))
        open_ = open_.where("lo < hi")
        if not open_.head(1):
            break
        ranges = open_.select("g", "lo", "hi").distinct()  # a row a group and wanted value
        width = (F.col("hi") - F.col("lo")) / BINS
        counts = rows.join(F.broadcast(ranges), "g").where("v BETWEEN lo AND hi").groupBy("g", "lo", "hi", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BINS - 1)).alias("bin"))
        counts = counts.agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = counts.withColumn("b", before)
        nearer = open_.join(bins, ["g", "lo", "hi"]).where("k >= b AND k < b + c")
        open_ = cut(nearer.select("g", "share", "part", "upper", (F.col("k") - F.col("b")).alias("k"), F.col("first").alias("lo"), F.col("last").alias("hi")))
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    low, high = (F.max(F.when(F.col("upper") == i, F.col("v"))) for i in (0, 1))
    return every.groupBy("g", "share").agg((low + (high - low) * F.max("part")).alias("v")).withColumnRenamed("g", by)


def tradeoff(rows: DataFrame, key: str, baseline: str) -> DataFrame:
    """What each condition of ``rows`` (``key``, tp, fp and metrics) saves and loses against the one named ``baseline``; shares in percent, 0 of nothing."""
    base = rows.where(F.col(key) == baseline).select(*[F.col(c).alias(f"{c}_0") for c in ("tp", "fp", "precision", "recall", "f1")])
    out = rows.crossJoin(F.broadcast(base))  # one row
    saved, lost = F.col("fp_0") - F.col("fp"), F.col("tp_0") - F.col("tp")
    share = lambda a, b: F.round(F.when(F.col(b) > 0, a / F.col(b) * 100).otherwise(0.0), 4)
    points = [F.round((F.col(c) - F.col(f"{c}_0")) * 100, 4).alias(f"{c}_pp") for c in ("precision", "recall")]
    return out.select(key, saved.alias("fp_saved"), share(saved, "fp_0").alias("fp_saved_pct"), lost.alias("tp_lost"), share(lost, "tp_0").alias("tp_lost_pct"), *points, F.round(F.col("f1") - F.col("f1_0"), 6).alias("f1_change"), F.round(saved / F.greatest(lost, F.lit(1)), 6).alias("benefit"))


def leaderboard(scenes: DataFrame, latency: DataFrame, meta: DataFrame) -> DataFrame:
    """A row a model: metrics of all its counts, mean scene F1, times (model, mean_ms, p50_ms, p95_ms) and what ``meta`` (model, ...) says of it."""
    sums = scenes.groupBy("model").agg(F.count("*").alias("scenes"), F.round(F.avg("f1"), 5).alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    out = with_metrics(sums).withColumn("total_pixels", F.expr("tp + fp + fn + tn")).join(latency, "model", "left").join(meta, "model", "left")
    return out.withColumn("patch_ms", F.round(F.col("mean_ms") / 16, 2))


def d15_latency(spark: SparkSession, d: str) -> DataFrame:
    """Times by stage: count, total, mean, extremes and two quantiles."""
    events, v = table(spark, d, "events"), F.col("value")
    found = events.groupBy(F.col("event_type").alias("stage")).agg(F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("lo"), F.round(F.max(v), 6).alias("hi"))
    q = exact_quantiles(events.withColumnRenamed("event_type", "stage"), "stage", "value", [0.5, 0.95])
    wide = q.groupBy("stage").agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("v"))), 6).alias(n) for n, s in (("p50", 0.5), ("p95", 0.95))])
    return found.join(wide, "stage", "left")


def d16_bootstrap(spark: SparkSession, d: str, draws: int = 1000) -> DataFrame:
    return bootstrap(with_metrics(per_scene(spark, d)), draws)


def d17_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return paired_tests(with_metrics(per_scene(spark, d)), [("a", "b")])


def d18_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    """Two models at three thresholds each, against model a at the middle one."""
    rows = scores(spark, d).select("model", "score", "gt", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7))).alias("tenths"))
    cm = confusion(rows.withColumn("cond", F.concat("model", F.lit("_"), "tenths")), ["cond"], F.col("score") >= F.col("tenths") / 10)
    return tradeoff(with_metrics(cm), "cond", "a_5")


def d19_degradation(spark: SparkSession, d: str) -> DataFrame:
    """Model b against model a as control, scene by scene."""
    m = with_metrics(per_scene(spark, d))
    a, b = (m.where(F.col("model") == x).select("scene_id", *[F.col(c).alias(f"{c}_{x}") for c in ("f1", "iou", "precision", "recall", "tp", "fp", "tn")]) for x in "ab")
    part = lambda of, whole: F.round(F.when(whole > 0, of / whole * 100).otherwise(0.0), 4)
    loss = lambda c: part(F.col(f"{c}_a") - F.col(f"{c}_b"), F.col(f"{c}_a"))
    more = F.col("fp_b") - F.col("fp_a")
    deltas = [F.round(F.col(f"{c}_b") - F.col(f"{c}_a"), 6).alias(f"{c}_delta") for c in ("f1", "iou", "precision", "recall")]
    return a.join(b, "scene_id").select("scene_id", *deltas, loss("f1").alias("f1_loss_pct"), loss("iou").alias("iou_loss_pct"), more.alias("fp_more"), part(more, F.col("fp_a")).alias("fp_more_pct"), part(more, F.col("tn_a") + F.col("fp_a")).alias("fp_rate_pct"), (F.col("tp_b") - F.col("tp_a")).alias("tp_more"))


#: What is told of the models of the queries.
META = [("a", "Model a", "pixel rule", 0.41, "validation", 0, "verified"), ("b", "Model b", "pixel rule", 0.7, "validation", 0, "verified")]
META_SCHEMA = "model string, display_name string, kind string, threshold double, threshold_source string, parameters long, status string"


def d21_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Models with the times of the events that stand for their runs."""
    model = F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("model")
    runs = table(spark, d, "events").select(model, "value").where("value IS NOT NULL")
    q = exact_quantiles(runs, "model", "value", [0.5, 0.95]).groupBy("model").agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("v"))), 2).alias(n) for n, s in (("p50_ms", 0.5), ("p95_ms", 0.95))])
    latency = runs.groupBy("model").agg(F.round(F.avg("value"), 2).alias("mean_ms")).join(q, "model")
    return leaderboard(with_metrics(per_scene(spark, d)), latency, spark.createDataFrame(META, META_SCHEMA))


def d22_iterations(spark: SparkSession, d: str) -> DataFrame:
    """Runs by kind: mean, sample deviation and largest time, and what memory grew by on average, the event's number modulo 100 standing for it before."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.max(v), 6).alias("most"), F.round(F.avg(v - F.col("event_id") % 100), 6).alias("mean_delta"))


def d23_dispersion(spark: SparkSession, d: str) -> DataFrame:
    q = exact_quantiles(with_metrics(per_scene(spark, d)), "model", "f1", [i / 4 for i in range(5)])
    return q.groupBy("model").agg(*[F.round(F.max(F.when(F.col("share") == i / 4, F.col("v"))), 6).alias(f"q{i}") for i in range(5)])


QUERIES = {f.__name__: f for f in (d15_latency, d16_bootstrap, d17_wilcoxon, d18_tradeoff, d19_degradation, d21_leaderboard, d22_iterations, d23_dispersion)}
_X0 = f"(rep * 1000003 + i * 7919 + 104729) % {PRIME}"
_DRAWS = f"""no AS (SELECT scene_id, row_number() OVER (ORDER BY scene_id) - 1 AS no FROM (SELECT DISTINCT scene_id FROM m)), x0 AS (SELECT rep, i, {_X0} AS x FROM range(1000) a(rep), range((SELECT count(*) FROM no)) b(i)),
x1 AS (SELECT rep, i, ((x * x + 12345) % {PRIME} * 48271 + i) % {PRIME} AS x FROM x0), dr AS (SELECT rep, (x * x + rep) % {PRIME} % (SELECT count(*) FROM no) AS no FROM x1)"""
_SHARES = (("macro_f1", "macro"), ("precision", "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"), ("recall", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"), ("f1", "CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"), ("iou", "CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END"))
#: Tail of the normal by Simpson's rule over 2000 steps from |z| to |z| + 12.
_TAIL = "(SELECT 2 * 0.006 / 3 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) + k * 0.006, 2) / 2)) FROM range(2001) t(k))"


def _part(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) * 100 ELSE 0 END, 4)"


SQL = {
    "d15_latency": "SELECT event_type AS stage, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY ALL",
    "d16_bootstrap": f"{MS}, {_DRAWS}, s AS (SELECT model, rep, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS macro FROM dr JOIN no USING (no) JOIN m USING (scene_id) GROUP BY ALL), f AS (" + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {v} AS v FROM s" for n, v in _SHARES) + ") SELECT model, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM f GROUP BY ALL",
    "d17_wilcoxon": f"""{MS}, v AS (SELECT scene_id, model, 'f1' AS metric, f1 AS v FROM m UNION ALL SELECT scene_id, model, 'iou', iou FROM m), df AS (SELECT a.metric, a.v AS va, b.v AS vb, round(a.v - b.v, 6) AS diff FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.metric = b.metric AND a.model = 'a' AND b.model = 'b'),
r AS (SELECT metric, diff, count(*) OVER (PARTITION BY metric, abs(diff)) AS t, rank() OVER (PARTITION BY metric ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY metric, abs(diff)) - 1) / 2 AS rk FROM df WHERE diff <> 0),
w AS (SELECT metric, count(*) AS n, coalesce(sum(rk) FILTER (diff > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (diff < 0), 0) AS w_minus, sum(t * t - 1) AS ties FROM r GROUP BY metric),
z AS (SELECT metric, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w),
e AS (SELECT metric, count(*) AS n_scenes, round(avg(va), 6) AS mean_a, round(avg(vb), 6) AS mean_b, round(avg(va - vb), 6) AS delta_mean FROM df GROUP BY metric)
SELECT 'a' AS model_a, 'b' AS model_b, metric, n_scenes, mean_a, mean_b, delta_mean, n::BIGINT AS n, w_plus, w_minus, statistic, round(z, 6) AS z, round({_TAIL}, 6) AS p_value, round({_TAIL}, 6) < 0.05 AS significant FROM z JOIN e USING (metric)""",
    "d18_tradeoff": f"WITH {SQL_SCORES}, c AS (SELECT model || '_' || t AS cond, gt, score >= t / 10 AS hit FROM scores, (SELECT unnest([3, 5, 7]) AS t)), k AS (SELECT cond, count(*) FILTER (hit AND gt = 1) AS tp, count(*) FILTER (hit AND gt = 0) AS fp, count(*) FILTER (NOT hit AND gt = 1) AS fn, count(*) FILTER (NOT hit AND gt = 0) AS tn FROM c GROUP BY cond), w AS (SELECT *, {METRICS} FROM k)"
    f" SELECT w.cond, b.fp - w.fp AS fp_saved, {_part('b.fp - w.fp', 'b.fp')} AS fp_saved_pct, b.tp - w.tp AS tp_lost, {_part('b.tp - w.tp', 'b.tp')} AS tp_lost_pct, round((w.precision - b.precision) * 100, 4) AS precision_pp, round((w.recall - b.recall) * 100, 4) AS recall_pp, round(w.f1 - b.f1, 6) AS f1_change, round((b.fp - w.fp) / greatest(b.tp - w.tp, 1), 6) AS benefit FROM w JOIN w b ON b.cond = 'a_5'",
    "d19_degradation": f"{MS}SELECT a.scene_id, " + ", ".join(f"round(b.{c} - a.{c}, 6) AS {c}_delta" for c in ("f1", "iou", "precision", "recall")) + f", {_part('a.f1 - b.f1', 'a.f1')} AS f1_loss_pct, {_part('a.iou - b.iou', 'a.iou')} AS iou_loss_pct, b.fp - a.fp AS fp_more, {_part('b.fp - a.fp', 'a.fp')} AS fp_more_pct, {_part('b.fp - a.fp', 'a.tn + a.fp')} AS fp_rate_pct, b.tp - a.tp AS tp_more FROM m a JOIN m b ON a.scene_id = b.scene_id AND a.model = 'a' AND b.model = 'b'",
    "d21_leaderboard": f"{MS}, t AS (SELECT model, count(*) AS scenes, round(avg(f1), 5) AS macro_f1, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM m GROUP BY model), l AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS model, round(avg(value), 2) AS mean_ms, round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms FROM events GROUP BY ALL), "
    f"h AS (FROM (VALUES ('a', 'Model a', 'pixel rule', 0.41::DOUBLE, 'validation', 0::BIGINT, 'verified'), ('b', 'Model b', 'pixel rule', 0.7::DOUBLE, 'validation', 0::BIGINT, 'verified')) h(model, display_name, kind, threshold, threshold_source, parameters, status)) SELECT t.*, {METRICS}, tp + fp + fn + tn AS total_pixels, mean_ms, p50_ms, p95_ms, round(mean_ms / 16, 2) AS patch_ms, h.* EXCLUDE (model) FROM t LEFT JOIN l USING (model) LEFT JOIN h USING (model)",
    "d22_iterations": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(max(value), 6) AS most, round(avg(value - event_id % 100), 6) AS mean_delta FROM events GROUP BY ALL",
    "d23_dispersion": MS + "SELECT model, " + ", ".join(f"round(quantile_cont(f1, {p / 4}), 6) AS q{p}" for p in range(5)) + " FROM m GROUP BY ALL",
}
