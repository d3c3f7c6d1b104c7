"""Reports of scenes and tables of cases, and plain selections of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.operators import raster
from orbitlake.operators.evaluation import MS, per_scene, with_metrics
from orbitlake.operators.reports import DIAG, GATE, diagnostics, gate
from orbitlake.sources.fixtures import SQL_PIXELS, pixels, table

# fixed values: sentences of a report
DETECTOR = "Core change detection executed using %s under decision threshold tau* = %.4f."
DETECTED = "Total detected changed area: %,d pixels (%.2f%% of evaluated scene)."
CLUSTERED = "Spatial clustering identified %d primary significant change regions."
REGISTERED = "Co-registration status: %s (confidence score: %.3f)."
BYPASSED = "Images assumed pre-registered; automated co-registration was bypassed."
AREA = "%,d pixels (%.2f%% of canvas)"
GROUND = " [~%,.1f m² based on GSD=%.2f m/px]"
LIMITATIONS = (
    "Inference executed under CPU constraints using patch-based bitemporal tiling.",
    "Visual categorizations are probabilistic interpretations, NOT verified ground truth.",
    "Optical VARI is an RGB visible greenness proxy and must NOT be equated with multispectral NDVI.",
)
NO_GSD = "Ground Sample Distance (GSD) metadata is absent; physical area measurements in square metres cannot be computed."
INSPECT = "Inspect Region #%d on high-resolution optical basemaps if ground truth verification is required."
SPOT_CHECK = "Spot-check primary change site (Region #1, %,d pixels)."
SUMMARY = "Bitemporal change detection identified %d significant change regions covering %,d pixels (%.2f%% of canvas) using %s (tau* = %.4f). Localized interpretations suggest %s."
UNVERIFIED = "unverified"
QUANTITATIVE, QUALITATIVE = "Quantitative Benchmark Evaluation", "Qualitative Case Study Evidence"
MODEL, TAU = "M9_BIT_CD", 0.45


def _lines(rows: Column, line) -> Column:
    return F.array_join(F.transform(rows, line), "\n")


def region_report(regions: DataFrame, findings: DataFrame, diagnostics: DataFrame, model: str = MODEL, tau: float = TAU) -> DataFrame:
    """A report a scene, all text, each part's lines apart by newlines.

    ``regions`` (scene_id, region_id from 1, pixel_area, area_ratio, gsd) are the few that a scene reports; gsd, null
    or not above 0 where unknown, holds for the scene. ``findings`` (scene_id, region_id, category, review) and
    ``diagnostics`` (scene_id, status, confidence) may lack rows. Areas on the ground are given only with a gsd. A confidence is rounded as the binary number that it is: 0.5085 is less than it looks and gives 0.508.
    """
    rows = regions.join(findings, ["scene_id", "region_id"], "left")
    one = F.struct("region_id", "pixel_area", "area_ratio", F.coalesce("category", F.lit(UNVERIFIED)).alias("category"), F.coalesce("review", F.lit(False)).alias("review"))
    by = rows.groupBy("scene_id").agg(F.array_sort(F.collect_list(one)).alias("r"), F.sum("pixel_area").alias("total"), F.sum("area_ratio").alias("share"), F.max("gsd").alias("gsd"), F.count("*").alias("n"))
    by = by.join(diagnostics, "scene_id", "left")
    known = F.col("gsd").isNotNull() & (F.col("gsd") > 0)
    pct = lambda share: F.bround(share * 100, 2)

    def area(x: Column) -> Column:
        ground = F.format_string(GROUND, F.bround(x["pixel_area"] * F.col("gsd") * F.col("gsd"), 1), F.col("gsd"))
        return F.concat(F.format_string("#%d: " + AREA, x["region_id"], x["pixel_area"], pct(x["area_ratio"])), F.when(known, ground).otherwise(""))

    inspect = F.filter("r", lambda x: x["review"])
    detector = [F.format_string(DETECTOR, F.lit(model), F.lit(tau)), F.format_string(DETECTED, "total", pct(F.col("share"))), F.format_string(CLUSTERED, "n")]
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("r.category"))), ", ")
    return by.select(
        "scene_id",
        F.concat_ws("\n", *detector).alias("detector"),
        F.when(F.col("status").isNull(), BYPASSED).otherwise(F.format_string(REGISTERED, "status", F.floor(F.col("confidence") * 1000 + 0.5) / 1000)).alias("registration"),
        _lines(F.col("r"), area).alias("regions"),
        F.concat_ws("\n", *map(F.lit, LIMITATIONS), F.when(F.col("gsd").isNull(), NO_GSD)).alias("limitations"),
        F.when(F.size(inspect) > 0, _lines(inspect, lambda x: F.format_string(INSPECT, x["region_id"]))).otherwise(F.format_string(SPOT_CHECK, F.get("r", F.lit(0))["pixel_area"])).alias("review"),
        F.format_string(SUMMARY, "n", "total", pct(F.col("share")), F.lit(model), F.lit(tau), kinds).alias("summary"),
    )


def case_table(cases: DataFrame) -> DataFrame:
    """``cases`` (has_ground_truth, status, gt_pixels and any others) with the class of their evidence; gt_pixels counts only where there is ground truth and success."""
    measured = F.col("has_ground_truth") & (F.col("status") == "success")
    return cases.withColumns({"gt_pixels": F.when(measured, F.col("gt_pixels")), "evidence": F.when(measured, QUANTITATIVE).otherwise(QUALITATIVE)})


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and the side."""
    return a.select(key).join(b, key, "left_anti").withColumn("side", F.lit("a")).union(b.select(key).join(a, key, "left_anti").withColumn("side", F.lit("b")))


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    status = gate(*[F.col(c) for c in ("matches", "inliers", "error", "score")])
    return diagnostics(spark, d).select(F.col("o_orderkey").alias("scene_id"), status.alias("status"), F.col("score").alias("confidence"))


def n2_region_reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents as regions, five ids in a row as a scene; labels as findings."""
    place = ["cast(floor(doc_id / 5) AS bigint) AS scene_id", "cast(doc_id % 5 + 1 AS int) AS region_id"]
    regions = table(spark, d, "documents").selectExpr(*place, "n_chars AS pixel_area", "n_chars / 65536D AS area_ratio", "CASE WHEN floor(doc_id / 5) % 2 = 0 THEN 0.5D END AS gsd")
    findings = table(spark, d, "labels").selectExpr(*place, "CASE WHEN quality = 1 THEN 'new_construction' ELSE 'uncertain' END AS category", "toxic = 1 AS review")
    return region_report(regions, findings, _diagnostics(spark, d))


def n4_case_table(spark: SparkSession, d: str) -> DataFrame:
    """Scenes as cases: two of three have ground truth; the alignment gate tells which came through."""
    counts = pixels(spark, d).groupBy("scene_id").agg(F.count_if(F.expr(f"{raster.DIFF} >= {raster.CUT}D")).alias("predicted_pixels"), F.sum("gt").alias("gt_pixels"))
    rows = counts.join(_diagnostics(spark, d), "scene_id", "left").withColumn("has_ground_truth", F.col("scene_id") % 3 != 0)
    return case_table(rows.withColumn("status", F.when(F.col("status") == "rejected", "rejected").otherwise("success")).drop("confidence"))


def c8_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that only one of two models has, where each lacks some."""
    m = per_scene(spark, d).select("scene_id", "model")
    return unmatched(m.where("model = 'a' AND scene_id % 7 <> 0").select("scene_id"), m.where("model = 'b' AND scene_id % 5 <> 0").select("scene_id"), "scene_id")


def b1_filter_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split").where("split = 'test'")


def b3_slice_results(spark: SparkSession, d: str) -> DataFrame:
    """One model at one severity, here a scene's remainder by four."""
    return with_metrics(per_scene(spark, d)).withColumn("severity", F.col("scene_id") % 4).where("model = 'b' AND severity = 1").select("scene_id", "tp", "fp", "f1")


def g3_subset(spark: SparkSession, d: str) -> DataFrame:
    """The documents that a list of ids, here those of the benchmark's items, names."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")).distinct()
    return table(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "lang")


QUERIES = {f.__name__: f for f in (n2_region_reports, n4_case_table, c8_unmatched, b1_filter_split, b3_slice_results, g3_subset)}


def _sum(of: str) -> str:
    return f"printf('%.2f', {of} * 100)"


SQL = {
    "n2_region_reports": DIAG + f""", g AS (SELECT o_orderkey AS scene_id, {GATE} AS status, score FROM s),
r AS (SELECT doc_id // 5 AS scene_id, doc_id % 5 + 1 AS id, n_chars AS a, coalesce(CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'new_construction' ELSE 'uncertain' END, '{UNVERIFIED}') AS cat, coalesce(toxic = 1, FALSE) AS rev FROM documents LEFT JOIN labels l USING (doc_id)),
b AS (SELECT scene_id, count(*) AS n, format('{{:,}}', sum(a)::BIGINT) AS total, {_sum('sum(a) / 65536')} AS pct, string_agg(DISTINCT cat, ', ' ORDER BY cat) AS kinds, arg_min(a, id) AS first,
  string_agg('#' || id || ': ' || format('{{:,}}', a) || ' pixels (' || {_sum('a / 65536')} || '% of canvas)' || CASE WHEN scene_id % 2 = 0 THEN ' [~' || format('{{:,.1f}}', a * 0.25::DOUBLE) || ' m² based on GSD=0.50 m/px]' ELSE '' END, chr(10) ORDER BY id) AS regions,
  string_agg('Inspect Region #' || id || ' on high-resolution optical basemaps if ground truth verification is required.', chr(10) ORDER BY id) FILTER (rev) AS ins FROM r GROUP BY scene_id)
SELECT scene_id, 'Core change detection executed using M9_BIT_CD under decision threshold tau* = 0.4500.' || chr(10) || 'Total detected changed area: ' || total || ' pixels (' || pct || '% of evaluated scene).' || chr(10) || 'Spatial clustering identified ' || n || ' primary significant change regions.' AS detector,
  CASE WHEN status IS NULL THEN '{BYPASSED}' ELSE 'Co-registration status: ' || status || ' (confidence score: ' || printf('%.3f', round(score, 3)) || ').' END AS registration, regions,
  '{LIMITATIONS[0]}' || chr(10) || '{LIMITATIONS[1]}' || chr(10) || '{LIMITATIONS[2]}' || CASE WHEN scene_id % 2 = 0 THEN '' ELSE chr(10) || '{NO_GSD}' END AS limitations,
  coalesce(ins, 'Spot-check primary change site (Region #1, ' || format('{{:,}}', first) || ' pixels).') AS review,
  'Bitemporal change detection identified ' || n || ' significant change regions covering ' || total || ' pixels (' || pct || '% of canvas) using M9_BIT_CD (tau* = 0.4500). Localized interpretations suggest ' || kinds || '.' AS summary FROM b LEFT JOIN g USING (scene_id)""",
    "n4_case_table": DIAG + f""", g AS (SELECT o_orderkey AS scene_id, {GATE} AS gate FROM s), {SQL_PIXELS}, c AS (SELECT scene_id, count(*) FILTER ({raster.D} >= {raster.CUT}) AS predicted_pixels, sum(gt)::BIGINT AS gt_pixels FROM pixels GROUP BY ALL),
k AS (SELECT c.*, scene_id % 3 <> 0 AS has_ground_truth, if(gate = 'rejected', 'rejected', 'success') AS status FROM c LEFT JOIN g USING (scene_id))
SELECT scene_id, predicted_pixels, has_ground_truth, status, CASE WHEN has_ground_truth AND status = 'success' THEN gt_pixels END AS gt_pixels, CASE WHEN has_ground_truth AND status = 'success' THEN '{QUANTITATIVE}' ELSE '{QUALITATIVE}' END AS evidence FROM k""",
    "c8_unmatched": MS + "SELECT scene_id, CASE WHEN scene_id % 5 = 0 THEN 'a' ELSE 'b' END AS side FROM (SELECT DISTINCT scene_id FROM m) WHERE (scene_id % 5 = 0) <> (scene_id % 7 = 0)",
    "b1_filter_split": "SELECT doc_id, 'test' AS split FROM documents WHERE doc_id % 5 = 0",
    "b3_slice_results": MS + "SELECT scene_id, tp, fp, f1 FROM m WHERE model = 'b' AND scene_id % 4 = 1",
    "g3_subset": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
}
