"""Quality rules by weak supervision.

Rules look at statistics of a text and vote good, vote bad, or abstain. How far each
rule can be trusted is estimated without labels: expectation-maximisation fits a
two-class model in which votes are independent given the class (Dawid & Skene 1979),
with abstaining as a third outcome. A document's posterior probability of being good
replaces the all-must-pass filter.

Statistics and votes are DataFrame expressions in one projection. EM needs only how
often each pattern of votes occurs: an exact count over all documents with at most
3 ** rules rows, whatever the number of documents. Counts are integers and the
patterns are taken in order, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm.common import WORD, cut, fixed, table, words

SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BAD, ABSTAIN, GOOD = 0, 1, 2


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars)).cast("long")


def _covered(starts: Column) -> Column:
    """Words in windows of three at the given starts, in order."""
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and a struct ``q`` of statistics of the whole text.

    Null and blank texts have zeros throughout.
    """
    keep = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    out = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), row.alias("_row"))
    out = fixed(out, _w=words(F.col("_text")))
    w, n = F.col("_w"), F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    out = fixed(out, _s=F.sort_array(windows))
    s, m = F.col("_s"), F.size("_s")
    twice = F.filter(F.sequence(F.lit(0), m - 1), lambda k: (F.get(s, k)["h"] == F.get(s, k + 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k - 1)["h"]))
    starts = F.when(m > 0, F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"])))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(WORD))
    out = fixed(out, _lines=lines, _starts=starts)
    text = F.col("_text")
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(text, "[A-Z]").alias("n_upper"),
        _count(text, "[!?]").alias("n_calls"),
        _count(text, "[.,;:]").alias("n_stops"),
    )
    return fixed(out, q=stats).select(F.col("_row.*"), "q") if keep else fixed(out, q=stats).select("q")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def votes(q: Column) -> Column:
    """Array of the rules' votes. A rule that only knows a fault abstains where it finds none."""
    n, chars = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["word_chars"], F.lit(1))
    length = q["word_chars"] / n

    def fault(bad: Column) -> Column:
        return F.when(bad, BAD).otherwise(ABSTAIN)

    def both(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return F.array(
        fault(q["n_symbols"] > 0.15 * n),
        fault(q["n_upper"] > 0.3 * chars),
        fault(q["n_calls"] > 0.2 * n),
        fault(q["n_dup_lines"] > 0.3 * q["n_lines"]),
        fault(q["n_repeat_words"] > 0.3 * n),
        both((length < 2.5) | (length > 12), (length >= 3) & (length <= 9)),
        both(q["n_stops"] < 0.002 * n, (q["n_stops"] >= 0.02 * n) & (q["n_stops"] <= 0.4 * n)),
    )


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior_bad: float = 0.1, trust: float = 0.9, weight: float = 2.0) -> tuple[float, list[list[list[float]]]]:
    """(probability of class good, [rule][class][vote] probabilities) for counted patterns of votes.

    Starts from rules taken at their word: a document with a bad vote is bad. ``weight``
    pseudo-documents a class keep every probability above 0.
    """
    rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    start = [0.01 ** v.count(BAD) if BAD in v else 0.999 for v, _ in patterns]
    fake = [[1 - trust, trust / 2, (1 - trust) / 2], [(1 - trust) / 10, trust / 2, trust / 2]]
    good, prior, table_ = start, 1 - prior_bad, []
    for _ in range(rounds):
        mass = sum(n * g for (_, n), g in zip(patterns, good, strict=True))
        prior = (mass + weight * (1 - prior_bad)) / (total + weight)
        table_ = []
        for r in range(rules):
            sums = [[weight * f for f in fake[0]], [weight * f for f in fake[1]]]
            for (v, n), g in zip(patterns, good, strict=True):
                sums[0][v[r]] += n * (1 - g)
                sums[1][v[r]] += n * g
            table_.append([[x / sum(row) for x in row] for row in sums])
        odds = [math.log(prior / (1 - prior)) + sum(math.log(table_[r][1][v[r]] / table_[r][0][v[r]]) for r in range(rules)) for v, _ in patterns]
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, o)))) for o in odds]
        change = max((abs(a - b) for a, b in zip(good, new, strict=True)), default=0)
        good = new
        if change < 1e-9:
            break
    return prior, table_


def posterior(vote: Column, prior: float, probabilities: list[list[list[float]]]) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r, (bad, good) in enumerate(probabilities):
        gain = F.array(*[F.lit(math.log(g / b)) for b, g in zip(bad, good, strict=True)])
        odds = odds + F.get(gain, F.get(vote, F.lit(r)))
    return 1 / (1 + F.exp(-odds))


def count_patterns(rows: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of votes of the documents that pass the base rules, with their counts: at most 3 ** 7 rows."""
    counted = rows.where(~base_failed(F.col("q"))).groupBy(votes(F.col("q")).alias("v")).agg(F.count("*").alias("n"))
    return sorted((tuple(r["v"]), r["n"]) for r in counted.collect())


def _verdict(rows: DataFrame, model: tuple[float, list], threshold: float) -> DataFrame:
    rows = rows.withColumn("p_good", posterior(votes(F.col("q")), *model) if model[1] else F.lit(1.0))
    return rows.withColumn("kept", ~base_failed(F.col("q")) & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text and any others) that pass the base rules and are more likely good than not.

    Rows with null or empty texts go. Repeated rows share a verdict.
    """
    model = fit(count_patterns(measured(docs, [])))
    return _verdict(measured(docs.select(F.struct("*").alias("_doc"), "text"), ["_doc"]), model, threshold).where("kept").select("_doc.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict, posterior and final verdict of every document."""
    rows = cut(measured(table(spark, sf_dir, "documents"), ["doc_id"]))
    out = _verdict(rows, fit(count_patterns(rows)), 0.5)
    return out.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in BASE], base_failed(F.col("q")).alias("base_failed"), "kept", "p_good")
