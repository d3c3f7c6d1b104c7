"""Deterministic splits and balanced samples, and checks that splits don't leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions.contracts import unique
from orbitlake.sources.fixtures import table


def seeded(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def positions(rows: DataFrame, key: str, seed: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``pos``, each row's place from 0 in the order of a seeded hash of ``key`` (in its group).

    Rows are ranked within the 65,536 values of the hash's first four digits only; what
    lies before each of them comes from their counts, so that no task sorts all rows.
    """
    by = by or []
    dealt = rows.withColumn("_hash", seeded(seed, key)).withColumn("_digits", F.substring("_hash", 1, 4))
    earlier = Window.partitionBy(*by).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "_digits").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_digits", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_digits").orderBy("_hash", key))
    return dealt.withColumn("_place", place).join(before, [*by, "_digits"]).withColumn("pos", F.col("_before") + F.col("_place") - 1).drop("_hash", "_digits", "_place", "_before")


def make_split(ids: DataFrame, key: str, seed: str = "42", shares: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(key, split): train, val and test by ``shares``, the first two rounded half to even, the rest test.

    Shares that don't add up to 1 (within 1e-5) or are negative are an error; reading the split fails if a
    key occurs twice.
    """
    if abs(sum(shares) - 1) > 1e-5 or min(shares) < 0:
        raise ValueError(f"shares have to add up to 1: {shares}")
    n = ids.count()
    train, val = (round(n * share) for share in shares[:2])
    placed = positions(unique(ids.select(key), key), key, seed)
    return placed.select(key, F.when(F.col("pos") < train, "train").when(F.col("pos") < train + val, "val").otherwise("test").alias("split"))


def balanced_sample(rows: DataFrame, key: str, positive: Column, n: int, seed: int = 42, epoch: int = 0, fill: bool = False) -> DataFrame:
    """``n`` rows, half of them ``positive``, or as many as there are, without repeats, others in every ``epoch``; with ``fill`` negatives take the place of positives that are missing."""
    dealt = positions(rows.withColumn("_positive", positive), key, str(seed + 100 * epoch), ["_positive"])
    there = dealt.agg(F.count_if("_positive").alias("_p"))  # one row
    half = n // 2
    quota = F.when(F.col("_positive"), F.lit(half)).otherwise((n - F.least(F.lit(half), F.col("_p"))) if fill else F.lit(half))
    return dealt.crossJoin(F.broadcast(there)).where(F.col("pos") < quota).drop("_positive", "_p", "pos")


def split_overlap(manifest: DataFrame, key: str) -> DataFrame:
    """(first, second, key): ids that two splits share, for each pair of splits."""
    of = F.array_sort(F.collect_set("split"))
    sets = manifest.groupBy(key).agg(of.alias("s")).where(F.size("s") > 1)  # as many as there are splits at most
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return sets.select(key, F.explode(pairs).alias("x")).select("x.first", "x.second", key)


def gallery_contract(gallery: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """(problem, key) where a gallery isn't just the ids of the test split: test ids that it lacks, ids of other splits or of none in it."""
    both = gallery.select(key).distinct().withColumn("there", F.lit(True)).join(split.select(key, "split").distinct(), key, "full")
    lacking = (F.col("split") == "test") & F.col("there").isNull()
    problem = F.when(lacking, "missing from gallery").when(F.col("there") & F.col("split").isNull(), "in no split").when(F.col("there") & (F.col("split") != "test"), F.concat("split", F.lit(" id in gallery")))
    return both.select(problem.alias("problem"), key).where("problem IS NOT NULL")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return make_split(table(spark, d, "documents"), "doc_id")


def g1_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


def g2_balanced(spark: SparkSession, d: str) -> DataFrame:
    """As many rows of either quality label as the rarer one has."""
    rows = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    least = rows.groupBy("quality").agg(F.count("*").alias("n")).agg(F.min("n").alias("quota"))
    return positions(rows, "doc_id", "7", ["quality"]).join(F.broadcast(least)).where("pos < quota").select("doc_id", "quality")


def g2_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Samples of 60 labelled rows in two epochs, negatives being few, and of 600 with the place of missing positives filled."""
    rows = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    out = [balanced_sample(rows, "doc_id", F.col("quality") == 1, 60, epoch=e).withColumn("variant", F.lit(f"epoch_{e}")) for e in (0, 1)]
    out.append(balanced_sample(rows, "doc_id", F.col("quality") == 0, 600, fill=True).withColumn("variant", F.lit("filled")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def s1_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the splits of two seeds put apart."""
    docs = table(spark, d, "documents")
    return split_overlap(make_split(docs, "doc_id").union(make_split(docs, "doc_id", "43")), "doc_id")


def s3_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


def s4_parent_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Parents (seven ids in a row) whose parts lie in several splits."""
    return _split(spark, d).groupBy(F.floor(F.col("doc_id") / 7).alias("parent")).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def s5_gallery_contract(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the labelled documents from being the gallery of the test split."""
    return gallery_contract(table(spark, d, "labels"), _split(spark, d), "doc_id").groupBy("problem").agg(F.count("*").alias("ids"))


def d4_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once: fingerprint, smallest id and count."""
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def c9_categories(spark: SparkSession, d: str) -> DataFrame:
    """Documents by label, ``Unknown`` where there is none."""
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("c"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").groupBy(F.coalesce("c", F.lit("Unknown")).alias("category")).agg(F.count("*").alias("n"))


def d3_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Share of the corpus that each language and source holds, with subtotals."""
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


SPLIT = """sp AS (SELECT doc_id, CASE WHEN pos < round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN pos < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)) """
QUERIES = {f.__name__: f for f in (g1_split, g2_balanced, g2_epochs, s1_split_overlap, s3_unlabelled, s4_parent_leakage, s5_gallery_contract, d4_exact_duplicates, c9_categories, d3_distribution)}
SQL = {
    "g1_split": f"WITH {SPLIT} SELECT * FROM sp",
    "g2_balanced": "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) AS pos FROM labels WHERE quality IS NOT NULL) SELECT doc_id, quality FROM r WHERE pos <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY quality))",
    "g2_epochs": " UNION ALL ".join(f"SELECT doc_id, quality, '{v}' AS variant FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('{seed}:' || doc_id), doc_id) AS pos FROM labels WHERE quality IS NOT NULL) WHERE pos <= {quota}" for v, seed, quota in (("epoch_0", 42, 30), ("epoch_1", 142, 30), ("filled", 42, "CASE WHEN quality = 0 THEN 300 ELSE 600 - least(300, (SELECT count(*) FROM labels WHERE quality = 0)) END"))),
    "s1_split_overlap": f"WITH {SPLIT}, o AS (SELECT doc_id, CASE WHEN pos < round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN pos < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)) SELECT least(a.split, b.split) AS first, greatest(a.split, b.split) AS second, doc_id FROM sp a JOIN o b USING (doc_id) WHERE a.split <> b.split",
    "s3_unlabelled": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "s4_parent_leakage": f"WITH {SPLIT} SELECT doc_id // 7 AS parent, count(DISTINCT split) AS splits FROM sp GROUP BY ALL HAVING splits > 1",
    "s5_gallery_contract": f"WITH {SPLIT}, p AS (SELECT 'missing from gallery' AS problem FROM sp WHERE split = 'test' AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT split || ' id in gallery' FROM (SELECT DISTINCT doc_id FROM labels) JOIN sp USING (doc_id) WHERE split <> 'test' UNION ALL SELECT 'in no split' FROM (SELECT DISTINCT doc_id FROM labels) ANTI JOIN sp USING (doc_id)) SELECT problem, count(*) AS ids FROM p GROUP BY problem",
    "d4_exact_duplicates": "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING n > 1",
    "c9_categories": "SELECT coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'Unknown') AS category, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "d3_distribution": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)",
}
