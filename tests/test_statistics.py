"""Tests, intervals and quantiles against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest

from orbitlake.operators import kernels, statistics


def mean_ranks(sizes):
    order = sorted(sizes)
    return [sum(i + 1 for i, s in enumerate(order) if s == x) / order.count(x) for x in sizes]


def enumerated(diffs):
    """(statistic, two-sided p) over all signs."""
    ranks = mean_ranks([abs(d) for d in diffs])
    plus = sum(r for r, d in zip(ranks, diffs) if d > 0)
    w = min(plus, sum(ranks) - plus)
    at_most = sum(sum(r for r, s in zip(ranks, signs) if s) <= w + 1e-9 for signs in itertools.product((0, 1), repeat=len(ranks)))
    return w, min(1.0, 2 * at_most / 2 ** len(ranks))


def scenes(spark, values):
    rows = [(i, m, float(v), float(v) / 2) for m, of in values.items() for i, v in enumerate(of)]
    return spark.createDataFrame(rows, "scene_id long, model string, f1 double, iou double")


@pytest.mark.parametrize("seed", range(4))
def test_probabilities_are_those_of_all_signs(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(5, 13)
    a, b = [rng.randrange(20) / 20 for _ in range(n)], [rng.randrange(20) / 20 for _ in range(n)]
    diffs = [round(x - y, 6) for x, y in zip(a, b) if round(x - y, 6)]
    for r in statistics.paired_tests(scenes(spark, {"a": a, "b": b}), [("a", "b")]).collect():
        w, p = enumerated(diffs)
        assert (r["n"], r["statistic"], r["n_scenes"]) == (len(diffs), w, n) and abs(r["p_value"] - p) < 1e-6 and r["significant"] == (r["p_value"] < 0.05)


def test_several_pairs_and_pairs_without_difference(spark):
    frame = scenes(spark, {"a": [0.1, 0.2, 0.3], "b": [0.1, 0.2, 0.3], "c": [0.5, 0.6]})
    found = {(r["model_a"], r["model_b"], r["metric"]): r for r in statistics.paired_tests(frame, [("a", "b"), ("c", "a"), ("a", "none")]).collect()}
    same = found["a", "b", "f1"]
    assert (same["n"], same["statistic"], same["p_value"], same["significant"]) == (0, 0.0, 1.0, False)
    assert (found["c", "a", "iou"]["n_scenes"], found["c", "a", "iou"]["p_value"]) == (2, 0.5) and len(found) == 4


def test_large_samples_take_the_normal(spark):
    rng = random.Random(3)
    a, b = [rng.random() for _ in range(90)], [rng.random() * 0.8 for _ in range(90)]
    r = statistics.paired_tests(scenes(spark, {"a": a, "b": b}), [("a", "b")], ("f1",)).first()
    diffs = [round(x - y, 6) for x, y in zip(a, b)]
    ranks = mean_ranks([abs(d) for d in diffs])
    w = min(sum(r for r, d in zip(ranks, diffs) if d > 0), sum(r for r, d in zip(ranks, diffs) if d < 0))
    z = (w - 90 * 91 / 4) / math.sqrt(90 * 91 * 181 / 24)
    assert r["statistic"] == w and abs(r["z"] - z) < 1e-3 and abs(r["p_value"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 2e-6


@pytest.mark.parametrize("cell", [50_000, 7])
def test_intervals_are_those_of_single_draws(spark, monkeypatch, cell):
    monkeypatch.setattr(statistics, "SCENES_A_CELL", cell)
    rng = np.random.default_rng(1)
    rows = [(m, int(s), *(int(v) for v in rng.integers(0, 50, 3)), float(rng.random())) for m in "ab" for s in range(5, 25)]
    found = {(r["model"], r["metric"]): (r["mean"], r["lo"], r["hi"]) for r in statistics.bootstrap(spark.createDataFrame(rows, "model string, scene_id long, tp long, fp long, fn long, f1 double"), 200).collect()}
    for m in "ab":
        of, drawn = [r[2:] for r in rows if r[0] == m], {"f1": [], "macro_f1": [], "recall": []}
        for rep in range(200):
            some = [of[int(statistics.drawn(rep, np.int64(i), 20))] for i in range(20)]
            tp, fp, fn = (sum(r[k] for r in some) for k in range(3))
            drawn["f1"].append(2 * tp / (2 * tp + fp + fn))
            drawn["recall"].append(tp / (tp + fn))
            drawn["macro_f1"].append(np.mean([r[3] for r in some]))
        for metric, values in drawn.items():
            assert np.allclose(found[m, metric], (np.mean(values), *np.quantile(values, [0.025, 0.975])), atol=2e-6)


def test_draws_spread_as_chance_does():
    n = 100
    times = np.stack([np.bincount(statistics.drawn(rep, np.arange(n), n), minlength=n) for rep in range(1000)])
    assert abs(times.var(axis=1).mean() - (1 - 1 / n)) < 0.05 and abs((times == 0).mean() - (1 - 1 / n) ** n) < 0.01
    assert times.sum(axis=0).max() < 1000 + 5 * math.sqrt(1000) and times.sum(axis=0).min() > 1000 - 5 * math.sqrt(1000)
    assert abs(np.corrcoef(times[:-1].ravel(), times[1:].ravel())[0, 1]) < 0.02


def test_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": np.round(rng.lognormal(3, 2, 9000), 2), "same": np.full(50, 7.25), "one": np.array([-3.5]), "two": np.array([1e-9, 1e9]), "tied": rng.integers(0, 4, 500).astype(float)}
    rows = [(g, float(v)) for g, of in groups.items() for v in of] + [("hot", None), ("none", None), (None, 1.0)]
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = statistics.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()
    assert {(r["g"], r["share"]) for r in found} == {(g, s) for g in groups for s in shares}
    assert all(np.isclose(r["v"], np.quantile(groups[r["g"]], r["share"]), rtol=1e-12) for r in found)
    assert statistics.exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", shares).count() == 0


def test_tradeoff_and_degradation(spark):
    rows = spark.createDataFrame([("base", 100, 40, 0.7, 0.5, 0.6), ("gated", 90, 10, 0.9, 0.45, 0.58), ("worse", 100, 50, 0.6, 0.5, 0.55)], "cond string, tp long, fp long, precision double, recall double, f1 double")
    found = {r["cond"]: r for r in statistics.tradeoff(rows, "cond", "base").collect()}
    g, w = found["gated"], found["worse"]
    assert (g["fp_saved"], g["fp_saved_pct"], g["tp_lost"], g["tp_lost_pct"], g["benefit"], g["precision_pp"], g["f1_change"]) == (30, 75.0, 10, 10.0, 3.0, 20.0, -0.02)
    assert (w["fp_saved"], w["fp_saved_pct"], w["tp_lost"], w["benefit"]) == (-10, -25.0, 0, -10.0)
    pair = spark.createDataFrame([("d", "control", "none", 0.5, 0.3, 1000, 8000), ("d", "blur", "mild", 0.25, 0.0, 4000, 5000)], "detector string, family string, severity string, f1 double, iou double, fp long, tn long")
    r = kernels.degradation(pair).where("family = 'blur'").first()
    assert (r["f1_delta"], r["f1_loss_pct"], r["iou_loss_pct"], r["fp_more"], r["fp_more_pct"], r["fp_rate_pct"]) == (-0.25, 50.0, 100.0, 3000, 300.0, 33.3333)
