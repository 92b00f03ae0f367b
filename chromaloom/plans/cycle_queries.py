"""Cell-cycle counts, categories, circular statistics and template similarity."""

from pyspark.sql import functions as F

from chromaloom.functions.scalar import r
from chromaloom.operators import cellcycle as C
from chromaloom.operators import vectors as V
from chromaloom.sources import tables as T

from .common import ARCS, SOURCES, categorised
from .registry import query

COUNTS_SQL = """
SELECT c.fov, c.cell, c.celltype, s.modality, s.hybe, s.channel, count(p.uid) FILTER (p.p_exist IS NULL OR p.p_exist >= 0.5) AS n,
       sum(CASE WHEN p.uid IS NULL THEN 0 ELSE coalesce(p.p_exist, 1) END) AS soft, count(p.uid) AS candidates
FROM m_cells c CROSS JOIN m_sources s LEFT JOIN m_spots p
ON p.fov = c.fov AND p.cell = c.cell AND p.modality = s.modality AND p.hybe = s.hybe AND p.channel = s.channel GROUP BY ALL"""
GENES = {s: g for s, g in zip(SOURCES, ("g1", "g2", "g3", "g4"))}


def counts(spark, d):
    return C.count_table(T.cells(spark, d), T.spots(spark, d), SOURCES)


@query("count_table", f"""
SELECT k.fov, k.cell, k.celltype, k.modality, k.hybe, k.channel, n, round(soft, 6) AS soft, candidates, p_min, coalesce(n_stored, 0) AS n_stored
FROM ({COUNTS_SQL}) k LEFT JOIN (SELECT fov, modality, hybe, channel, count(*) AS n_stored, min(CASE WHEN cell >= 0 THEN p_exist END) AS p_min FROM m_spots GROUP BY 1, 2, 3, 4) f
ON f.fov = k.fov AND f.modality = k.modality AND f.hybe = k.hybe AND f.channel = k.channel""")
def count_table(spark, d):
    return counts(spark, d).withColumn("soft", r("soft"))


@query("gene_table", """
SELECT fov, cell, celltype, max(v) FILTER (hybe = 'Hyb_001') AS g1, max(v) FILTER (hybe = 'Hyb_002') AS g2, max(v) FILTER (hybe = 'Hyb_003') AS g3, max(v) FILTER (hybe = 'Hyb_004') AS g4
FROM (SELECT *, CASE WHEN candidates > 0 OR hybe <> 'Hyb_001' THEN n END AS v FROM (""" + COUNTS_SQL + """)) GROUP BY 1, 2, 3 HAVING max(v) FILTER (hybe = 'Hyb_001') IS NOT NULL""")
def gene_table(spark, d):
    """Hyb_001 counts are missing where nothing was stored, so those cells cannot be composed."""
    known = counts(spark, d).withColumn("n", F.when((F.col("candidates") > 0) | (F.col("hybe") != "Hyb_001"), F.col("n")))
    return C.gene_table(known, GENES)


@query("saturation_table", f"""
SELECT modality, hybe, channel, round(c, 6) AS candidates, round(a, 6) AS accepted, round(a / greatest(c, 1e-9), 6) AS accepted_fraction,
       a / greatest(c, 1e-9) < 0.7 AND c > 0.05 AS flag FROM (SELECT modality, hybe, channel, avg(candidates) AS c, avg(n) AS a FROM ({COUNTS_SQL}) GROUP BY 1, 2, 3)""")
def saturation_table(spark, d):
    t = C.saturation_table(counts(spark, d), 0.05, 0.7)
    return t.select("modality", "hybe", "channel", *[r(c).alias(c) for c in ("candidates", "accepted", "accepted_fraction")], "flag")


@query("categorize_arcs", """
SELECT fov, cell, CASE WHEN theta_deg IS NULL THEN '' WHEN (((theta_deg - 300) % 360) + 360) % 360 <= 120 THEN 'G1'
  WHEN (((theta_deg - 60) % 360) + 360) % 360 <= 120 THEN 'S' WHEN (((theta_deg - 180) % 360) + 360) % 360 <= 100 THEN 'G2/M' ELSE '' END AS category FROM m_placed""")
def categorize_arcs(spark, d):
    return T.placements(spark, d).select("fov", "cell", C.categorize("theta_deg", ARCS).alias("category"))


@query("assign_gates", "SELECT fov, cell, round(theta_deg, 6) AS theta_deg, category FROM m_category")
def assign_gates(spark, d):
    return categorised(spark, d).select("fov", "cell", r("theta_deg").alias("theta_deg"), "category")


BIN = "least(CAST(floor(theta_deg * {n} / 360.0) AS INTEGER), {n} - 1)"


@query("binned_stat", f"""
SELECT {BIN.format(n=24)} AS bin, count(*) AS n, ({BIN.format(n=24)} + 0.5) * CAST(15 AS DOUBLE) AS center, round(median(total), 6) AS value,
       round(quantile_cont(total, 0.25), 6) AS q25, round(quantile_cont(total, 0.75), 6) AS q75 FROM m_placed WHERE theta_deg IS NOT NULL GROUP BY 1""")
def binned_stat(spark, d):
    b = C.binned_stat(T.placements(spark, d), "total")
    return b.select("bin", "n", "center", *[r(c).alias(c) for c in ("value", "q25", "q75")])


@query("circular_summary", """
SELECT celltype, count(*) AS n, round(((degrees(atan2(avg(sin(radians(theta_deg))), avg(cos(radians(theta_deg))))) % 360) + 360) % 360, 5) AS mean_deg,
       round(sqrt(pow(avg(cos(radians(theta_deg))), 2) + pow(avg(sin(radians(theta_deg))), 2)), 6) AS concentration,
       round(avg(CASE WHEN fit_z < -2 THEN 1.0 ELSE 0.0 END), 6) AS frac_outside, round(avg(CASE WHEN ring_tail >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS frac_on_ring,
       round(median("R"), 6) AS "median_R", round(median(fit_z), 6) AS median_fit_z, round(median(radius), 6) AS median_radius
FROM m_placed p JOIN m_cells c ON c.cell = p.cell WHERE theta_deg IS NOT NULL GROUP BY 1""")
def circular_summary(spark, d):
    t = T.placements(spark, d).join(T.cells(spark, d).select("fov", "cell", "celltype"), ["fov", "cell"])
    s = C.circular_summary(t, ["celltype"])
    return s.select("celltype", "n", r("mean_deg", 5).alias("mean_deg"), *[r(c).alias(c) for c in (
        "concentration", "frac_outside", "frac_on_ring", "median_R", "median_fit_z", "median_radius")])


@query("phase_agreement", """
WITH x AS (SELECT abs((((a - b + 180) % 360) + 360) % 360 - 180) AS d FROM (SELECT theta_deg AS a, (theta_deg * 1.1) % CAST(360 AS DOUBLE) AS b FROM m_placed WHERE theta_deg IS NOT NULL))
SELECT count(*) AS n, round(avg(CASE WHEN d <= 30 THEN 1.0 ELSE 0.0 END), 6) AS frac_within_30, round(avg(CASE WHEN d <= 45 THEN 1.0 ELSE 0.0 END), 6) AS frac_within_45,
       round(avg(CASE WHEN d <= 90 THEN 1.0 ELSE 0.0 END), 6) AS frac_within_90, round(median(d), 6) AS median_abs_diff_deg FROM x""")
def phase_agreement(spark, d):
    a = T.placements(spark, d)
    b = a.withColumn("theta_deg", F.pmod(F.col("theta_deg") * 1.1, F.lit(360.0)))
    return C.phase_agreement(a, b).select("n", *[r(c).alias(c) for c in ("frac_within_30", "frac_within_45", "frac_within_90", "median_abs_diff_deg")])


@query("dna_by_fov", """
SELECT c.fov, c.cell, CASE WHEN m.n >= 5 AND m.med > 0 THEN round(c.area / m.med, 6) END AS area_norm
FROM m_cells c JOIN (SELECT fov, count(*) AS n, median(area) AS med FROM m_cells GROUP BY 1) m USING (fov)""")
def dna_by_fov(spark, d):
    return C.normalise_by_fov(T.cells(spark, d).select("fov", "cell", "area"), "area").select("fov", "cell", r("area_norm").alias("area_norm"))


@query("dna_curve", f"""
WITH m AS (SELECT {BIN.format(n=36)} AS bin, median(total) AS v FROM m_placed WHERE theta_deg IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)
SELECT a.bin, round(avg(b.v), 6) AS value FROM m a JOIN m b ON b.bin IN (a.bin, (a.bin + 1) % 36, (a.bin + 35) % 36) GROUP BY 1""")
def dna_curve(spark, d):
    """The 36 numbers of the curve; the medians behind them are one distributed aggregate."""
    _, curve = C.dna_curve(T.placements(spark, d), "total")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(curve)], "bin int, value double").withColumn("value", r("value"))


@query("total_drop", f"""
WITH m AS (SELECT {BIN.format(n=36)} AS bin, ln(median(total)) AS v FROM m_placed WHERE theta_deg IS NOT NULL AND total > 0 GROUP BY 1 HAVING count(*) >= 5),
k AS (SELECT j.bin, avg(m.v) FILTER ((j.bin - m.bin + 36) % 36 BETWEEN 1 AND 4) - avg(m.v) FILTER ((m.bin - j.bin + 36) % 36 BETWEEN 0 AND 3) AS c,
      max(m.v) FILTER ((j.bin - m.bin + 36) % 36 BETWEEN 1 AND 4) - min(m.v) FILTER ((m.bin - j.bin + 36) % 36 BETWEEN 0 AND 3) AS f FROM m j, m GROUP BY 1)
SELECT CAST(bin * 10 AS DOUBLE) AS angle_deg, round(exp(f), 6) AS factor FROM k ORDER BY c DESC LIMIT 1""")
def total_drop(spark, d):
    angle, factor = C.total_drop(T.placements(spark, d))
    return spark.createDataFrame([(angle, factor)], "angle_deg double, factor double").withColumn("factor", r("factor"))


COSINE = "list_inner_product(e.embedding::DOUBLE[], m.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(m.v, m.v)))"


@query("template_similarity", f"""
WITH u AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
m AS (SELECT label, list(x ORDER BY i) AS v FROM u GROUP BY 1)
SELECT vec_id, label, round({COSINE}, 6) AS similarity FROM embeddings e JOIN m USING (label)""")
def template_similarity(spark, d):
    """Cosine of every vector with its class template (the mean vector)."""
    vec = T.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return V.similarity_to_template(vec, V.templates(vec, ["label"]), ["label"], "vec_id").select("vec_id", "label", r("similarity").alias("similarity"))
