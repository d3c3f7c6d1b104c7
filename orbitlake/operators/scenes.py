"""Contrast, patches, vegetation, gates and categories over pixel and catalog tables; the SQL below is written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.operators.raster import vari
from orbitlake.sources import fixtures
from orbitlake.sources.fixtures import captions, pixels, scores, table

PIX = "{pixels}"
# fixed values: luma weights, in SQL
LUMA = ("2.989e-1", "5.87e-1", "1.14e-1")
# fixed values: bounds of a usable image
SMALLEST, LARGEST, BLANK, DARK, BRIGHT = 256, 16_777_216, 1e-4, 0.12, 0.88
# fixed values: stand-ins for captions
LEAD_INS = ("an aerial photograph of ", "a remote sensing image showing ", "satellite view of ")


def otsu(rows: DataFrame, bins: int = 256) -> DataFrame:
    """(model, tau, between_var): the first bin after which the classes of scores (model, score) lie furthest apart; from ``bins`` counts a model."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy("model", at.alias("b")).agg(F.count("*").cast("double").alias("n"))
    counts = counts.withColumn("m", F.col("n") * (F.col("b") + 0.5) / bins)
    below, every = Window.partitionBy("model").orderBy("b"), Window.partitionBy("model")
    sums = counts.select("model", "b", *[F.sum(c).over(w).alias(f"{c}{i}") for c in ("n", "m") for i, w in enumerate((below, every))])
    share = F.col("n0") / F.col("n1")
    apart = F.col("m0") / F.col("n0") - (F.col("m1") - F.col("m0")) / (F.col("n1") - F.col("n0"))
    found = sums.withColumn("between_var", F.when(F.col("n1") > F.col("n0"), F.round(share * (1 - share) * apart * apart, 9)).otherwise(0.0))
    best = found.groupBy("model").agg(F.max(F.struct("between_var", (-F.col("b")).alias("first"))).alias("x"))
    return best.select("model", F.round((0.5 - F.col("x.first")) / bins, 6).alias("tau"), "x.between_var")


def contrasted(rows: DataFrame, column: str, factors: list[float]) -> DataFrame:
    """(scene_id, factor, before, v): a channel further from its scene's mean, or nearer, held within 0 to 255."""
    mean = rows.groupBy("scene_id").agg(F.avg(column).alias("mean"))
    out = rows.join(mean.hint("shuffle_hash"), "scene_id").withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    v = (F.col(column) - F.col("mean")) * F.col("factor") + F.col("mean")
    return out.select("scene_id", "factor", F.col(column).alias("before"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)).alias("v"))


def image_reason(n: Column, deviation: Column, mean: Column) -> Column:
    """The first of what speaks against an image of n pixels, or valid."""
    ladder = [(n < SMALLEST, "too small"), (n > LARGEST, "too large"), (deviation < BLANK, "blank"), (mean < DARK, "dark"), (mean > BRIGHT, "bright")]
    return F.coalesce(*[F.when(c, r) for c, r in ladder], F.lit("valid"))


def j12_contrast(spark: SparkSession, d: str) -> DataFrame:
    rows = contrasted(pixels(spark, d), "r2", [1.3, 0.7])
    return rows.groupBy("scene_id", "factor").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.avg(F.abs(F.col("v") - F.col("before"))), 5).alias("moved"))


def d9_otsu(spark: SparkSession, d: str) -> DataFrame:
    return otsu(scores(spark, d))


def j20_regional_vari(spark: SparkSession, d: str) -> DataFrame:
    """Vegetation before and after within each scene's box of changed pixels."""
    rows = pixels(spark, d)
    box = rows.where("gt = 1").groupBy("scene_id").agg(*[f(c).alias(f"{c}{i}") for c in "yx" for i, f in enumerate((F.min, F.max))])
    inside = rows.join(box.hint("shuffle_hash"), "scene_id").where(F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    out = inside.groupBy("scene_id").agg(F.avg(vari(1)).alias("a"), F.avg(vari(2)).alias("b"))
    out = out.select("scene_id", F.round("a", 6).alias("v_before"), F.round("b", 6).alias("v_after"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))
    by = lambda least, up, down, else_: F.when(F.col("delta") >= least, up).when(F.col("delta") <= -least, down).otherwise(else_)
    return out.withColumns({"trend": by(0.15, "up", "down", "stable"), "category": by(0.2, "vegetation_increase", "vegetation_decrease", "uncertain")})


def j22_vari_exposure(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).withColumn("exposure", F.explode(F.array(*map(F.lit, (1.0, 1.6, 0.4)))))
    lit = rows.withColumns({f"{c}1": F.least(F.lit(255.0), F.col(f"{c}1") * F.col("exposure")) for c in "rgb"}).withColumn("v", vari(1))
    return lit.groupBy("exposure", "gt").agg(*[F.round(f("v"), 5).alias(n) for n, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))])


def k2_padded_patches(spark: SparkSession, d: str, size: int = 6) -> DataFrame:
    place = F.floor(F.col("y") / size) * (-(-fixtures.SIDE // size)) + F.floor(F.col("x") / size)
    found = pixels(spark, d).groupBy("scene_id", place.cast("int").alias("patch")).agg(F.count("*").alias("pixels"), F.sum("gt").cast("long").alias("changed"))
    return found.withColumns({"share": F.round(F.col("changed") / size**2, 6), "is_padded": F.col("pixels") < size**2})


def k6_tile_statistics(spark: SparkSession, d: str, size: int = 4) -> DataFrame:
    """Scenes by how many tiles they have, and whether these are all."""
    a_side = -(-fixtures.SIDE // size)
    tile = F.floor(F.col("y") / size) * a_side + F.floor(F.col("x") / size)
    tiles = pixels(spark, d).select("scene_id", tile.alias("tile")).distinct().groupBy("scene_id").agg(F.count("*").alias("tiles"))
    return tiles.groupBy("tiles").agg(F.count("*").alias("scenes")).withColumn("expected", F.col("tiles") == a_side**2)


def b6_image_gate(spark: SparkSession, d: str) -> DataFrame:
    luma = (0.2989 * F.col("r1") + 0.587 * F.col("g1") + 0.114 * F.col("b1")) / 255
    found = pixels(spark, d).groupBy("scene_id").agg(F.count("*").alias("n"), F.stddev_pop(luma).alias("s"), F.avg(luma).alias("mean"))
    return found.select("scene_id", image_reason(F.col("n"), F.col("s"), F.col("mean")).alias("reason"), F.round("s", 6).alias("sd"))


def b2_categories(spark: SparkSession, d: str) -> DataFrame:
    """Names by the letters they begin with, by what stands before the first _ and before the last."""
    name = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    head = lambda c, ok: F.when(ok & (c != ""), c)
    low = F.lower("name")
    first = F.substring_index(low, "_", 1)
    letters = F.regexp_replace(low, "[^a-z].*$", "")
    rest = F.expr("substring(name, 1, length(name) - length(substring_index(name, '_', -1)) - 1)")
    rows = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select(name.alias("name")).select(
        F.coalesce(head(letters, F.substring(low, F.length(letters) + 1, F.lit(1)).rlike("[_0-9]")), F.lit("unclassified")).alias("letters"),
        F.coalesce(head(first, F.contains("name", F.lit("_"))), F.lit("unclassified")).alias("first_part"),
        F.coalesce(head(rest, F.contains("name", F.lit("_"))), F.lit("unknown")).alias("all_but_last"),
    )
    return rows.groupBy("letters", "first_part", "all_but_last").agg(F.count("*").alias("n"))


def c2_pair_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Ids by the first of documents, labels and embeddings that lacks them."""
    a, b, c = (table(spark, d, t).select(F.col(k).alias("id")).distinct().withColumn(n, F.lit(True)) for t, k, n in (("documents", "doc_id", "a"), ("labels", "doc_id", "b"), ("embeddings", "vec_id", "c")))
    every = a.join(b, "id", "full").join(c, "id", "full")
    outcome = F.when(F.col("a").isNull(), "missing in A").when(F.col("b").isNull(), "missing in B").when(F.col("c").isNull(), "missing label").otherwise("complete")
    return every.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def c3_attach_captions(spark: SparkSession, d: str) -> DataFrame:
    counts = captions(spark, d).where("text IS NOT NULL").groupBy(F.col("image_id").alias("doc_id")).agg(F.count("*").alias("caption_count"))
    return table(spark, d, "documents").select("doc_id").join(counts, "doc_id", "left").fillna(0, ["caption_count"])


def h12_fallback_captions(spark: SparkSession, d: str) -> DataFrame:
    """Three captions from an image's category, for images without any."""
    said = F.transform(F.array(*map(F.lit, LEAD_INS)), lambda x: F.concat(x, F.translate("category", "_", " ")))
    return captions(spark, d).select("image_id", "category").distinct().select("image_id", F.posexplode(said).alias("caption_idx", "caption"))


def luma(i: int, weights: tuple[str, str, str] = LUMA) -> str:
    r, g, b = weights
    return f"({r} * r{i} + {g} * g{i} + {b} * b{i}) / 2.55e2"


def _vari(i: int) -> str:
    den = f"(g{i} + r{i} - b{i})"
    return f"CASE WHEN abs({den}) < 1e-6 THEN 0e0 ELSE greatest(-1e0, least(1e0, (g{i} - r{i}) * 1e0 / {den})) END"


#: Name: (inputs, SQL after WITH); doubles are written with an exponent.
TEXTS = {
    "j12_contrast": (["pixels"], f"m AS (SELECT scene_id, avg(r2) AS mr FROM {PIX} GROUP BY scene_id), f AS (SELECT * FROM (VALUES (1.3e0), (7e-1)) t(factor)), c AS (SELECT p.scene_id, factor, r2, least(2.55e2, greatest(0e0, (r2 - mr) * factor + mr)) AS v FROM {PIX} p JOIN m ON p.scene_id = m.scene_id CROSS JOIN f) SELECT scene_id, factor, round(avg(v), 5) AS mean, round(avg(abs(v - r2)), 5) AS moved FROM c GROUP BY scene_id, factor"),
    "d9_otsu": (["scores"], "h AS (SELECT model, CAST(least(floor(score * 256), 255) AS INT) AS b, count(*) * 1e0 AS n FROM {scores} GROUP BY model, CAST(least(floor(score * 256), 255) AS INT)), c AS (SELECT model, b, sum(n) OVER (PARTITION BY model ORDER BY b) AS w0, sum(n * (b + 5e-1) / 256) OVER (PARTITION BY model ORDER BY b) AS m0, sum(n) OVER (PARTITION BY model) AS w, sum(n * (b + 5e-1) / 256) OVER (PARTITION BY model) AS m FROM h), v AS (SELECT model, b, CASE WHEN w > w0 THEN round(w0 / w * (1 - w0 / w) * pow(m0 / w0 - (m - m0) / (w - w0), 2), 9) ELSE 0e0 END AS between_var FROM c) SELECT model, round((b + 5e-1) / 256, 6) AS tau, between_var FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY between_var DESC, b) AS rn FROM v) t WHERE rn = 1"),
    "j20_regional_vari": (["pixels"], f"box AS (SELECT scene_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM {PIX} WHERE gt = 1 GROUP BY scene_id), r AS (SELECT p.scene_id, avg({_vari(1)}) AS v1, avg({_vari(2)}) AS v2 FROM {PIX} p JOIN box b ON p.scene_id = b.scene_id AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY p.scene_id), d AS (SELECT scene_id, round(v1, 6) AS v_before, round(v2, 6) AS v_after, round(v2 - v1, 6) AS delta FROM r) SELECT *, CASE WHEN delta >= 1.5e-1 THEN 'up' WHEN delta <= -1.5e-1 THEN 'down' ELSE 'stable' END AS trend, CASE WHEN delta >= 2e-1 THEN 'vegetation_increase' WHEN delta <= -2e-1 THEN 'vegetation_decrease' ELSE 'uncertain' END AS category FROM d"),
    "j22_vari_exposure": (["pixels"], f"e AS (SELECT * FROM (VALUES (1e0), (1.6e0), (4e-1)) t(exposure)), p AS (SELECT exposure, gt, least(2.55e2, r1 * exposure) AS r1, least(2.55e2, g1 * exposure) AS g1, least(2.55e2, b1 * exposure) AS b1 FROM {PIX} CROSS JOIN e), v AS (SELECT exposure, gt, {_vari(1)} AS v FROM p) SELECT exposure, gt, round(avg(v), 5) AS mean, round(min(v), 5) AS lo, round(max(v), 5) AS hi FROM v GROUP BY exposure, gt"),
    "k2_padded_patches": (["pixels"], f"p AS (SELECT scene_id, CAST(floor(y / 6) * 3 + floor(x / 6) AS INT) AS patch, gt FROM {PIX}) SELECT scene_id, patch, count(*) AS pixels, CAST(sum(gt) AS BIGINT) AS changed, round(sum(gt) / 3.6e1, 6) AS share, count(*) < 36 AS is_padded FROM p GROUP BY scene_id, patch"),
    "k6_tile_statistics": (["pixels"], f"t AS (SELECT scene_id, CAST(floor(y / 4) * 5 + floor(x / 4) AS INT) AS tile FROM {PIX}), n AS (SELECT scene_id, count(DISTINCT tile) AS tiles FROM t GROUP BY scene_id) SELECT tiles, count(*) AS scenes, tiles = 25 AS expected FROM n GROUP BY tiles"),
    "b6_image_gate": (["pixels"], f"s AS (SELECT scene_id, count(*) AS n, stddev_pop({luma(1)}) AS sd, avg({luma(1)}) AS mean FROM {PIX} GROUP BY scene_id) SELECT scene_id, CASE WHEN n < 256 THEN 'too small' WHEN n > 16777216 THEN 'too large' WHEN sd < 1e-4 THEN 'blank' WHEN mean < 1.2e-1 THEN 'dark' WHEN mean > 8.8e-1 THEN 'bright' ELSE 'valid' END AS reason, round(sd, 6) AS sd FROM s"),
    "b2_categories": (["documents"], "d AS (SELECT doc_id, source || '_' || lang || '_' || doc_id AS name FROM {documents}), c AS (SELECT doc_id, coalesce(nullif(regexp_extract(lower(name), '^([a-z]+)[_0-9]', 1), ''), 'unclassified') AS letters, coalesce(nullif(regexp_extract(lower(name), '^([^_]*)_', 1), ''), 'unclassified') AS first_part, coalesce(nullif(regexp_extract(name, '^(.*)_', 1), ''), 'unknown') AS all_but_last FROM d) SELECT letters, first_part, all_but_last, count(*) AS n FROM c GROUP BY letters, first_part, all_but_last"),
    "c2_pair_completeness": (["documents", "labels", "embeddings"], "a AS (SELECT doc_id AS id, 1 AS side FROM {documents} UNION ALL SELECT doc_id, 2 FROM {labels} UNION ALL SELECT vec_id, 4 FROM {embeddings}), s AS (SELECT id, CAST(sum(DISTINCT side) AS INT) AS sides FROM a GROUP BY id) SELECT CASE WHEN sides % 2 = 0 THEN 'missing in A' WHEN sides % 4 < 2 THEN 'missing in B' WHEN sides < 4 THEN 'missing label' ELSE 'complete' END AS outcome, count(*) AS n FROM s GROUP BY CASE WHEN sides % 2 = 0 THEN 'missing in A' WHEN sides % 4 < 2 THEN 'missing in B' WHEN sides < 4 THEN 'missing label' ELSE 'complete' END"),
    "c3_attach_captions": (["documents", "captions"], "c AS (SELECT image_id, count(text) AS n FROM {captions} GROUP BY image_id) SELECT doc_id, coalesce(n, 0) AS caption_count FROM {documents} LEFT JOIN c ON doc_id = image_id"),
    "h12_fallback_captions": (["captions"], "k AS (SELECT DISTINCT image_id, category FROM {captions}), f AS (SELECT * FROM (VALUES (0, 'an aerial photograph of '), (1, 'a remote sensing image showing '), (2, 'satellite view of ')) t(caption_idx, lead_in)) SELECT image_id, caption_idx, lead_in || replace(category, '_', ' ') AS caption FROM k CROSS JOIN f"),
}
CTES = {"pixels": fixtures.SQL_PIXELS, "scores": fixtures.SQL_SCORES, "captions": fixtures.SQL_CAPTIONS}
FUNCTIONS = (j12_contrast, d9_otsu, j20_regional_vari, j22_vari_exposure, k2_padded_patches, k6_tile_statistics, b6_image_gate, b2_categories, c2_pair_completeness, c3_attach_captions, h12_fallback_captions)
QUERIES = {f.__name__: f for f in FUNCTIONS}


def _sql(name: str) -> str:
    inputs, text = TEXTS[name]
    return "WITH " + ", ".join([*(CTES[i] for i in inputs if i in CTES), text.format(**{i: i for i in inputs})])


SQL = {name: _sql(name) for name in QUERIES}
