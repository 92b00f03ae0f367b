"""Stored ring models, orientation, the DNA sawtooth, dispersion choice and gene elimination."""

import uuid

from pyspark.sql import functions as F

from chromaloom.functions.scalar import r
from chromaloom.operators import arcs as AR
from chromaloom.operators import cycle_choice as CC
from chromaloom.operators import cycle_frame as CF
from chromaloom.operators import cycle_model as CM
from chromaloom.operators import cycle_store as CS
from chromaloom.session import cut, ensure_checkpoint_dir
from chromaloom.sources import tables as T

from .model_queries import composed
from .registry import query

ALPHA, TRAIN_FOVS = 100.0, 15
EARLY, LATE = ["gene_1", "gene_2"], ["gene_5", "gene_6"]

# A ring from the stored phases: centred log counts per gene, their means and harmonics.
RING_SQL = """
cnt AS MATERIALIZED (SELECT fov, cell, k, CAST(sum(CASE WHEN hybe = 'Hyb_00' || CAST(k + 1 AS VARCHAR) THEN 1 ELSE 0 END) AS DOUBLE) AS x FROM m_counted, (SELECT unnest(range(7)) AS k) GROUP BY 1, 2, 3),
z AS MATERIALIZED (SELECT *, ln(x + 0.5) - avg(ln(x + 0.5)) OVER (PARTITION BY fov, cell) AS z FROM cnt),
mom AS MATERIALIZED (SELECT k, avg(z) AS a, 2 * avg(z * cos(t)) AS c1, 2 * avg(z * sin(t)) AS s1, 2 * avg(z * cos(2 * t)) AS c2, 2 * avg(z * sin(2 * t)) AS s2
  FROM z JOIN (SELECT fov, cell, radians(theta_deg) AS t FROM m_placed WHERE theta_deg IS NOT NULL) USING (fov, cell) GROUP BY k),
grid AS (SELECT t, t * 2 * pi() / 72 AS th FROM (SELECT unnest(range(72)) AS t)),
eta AS (SELECT k, t, th, c1 * cos(th) + s1 * sin(th) + c2 * cos(2 * th) + s2 * sin(2 * th) AS f, a FROM mom, grid),
lp AS MATERIALIZED (SELECT k, t, th, f + a - ln(sum(exp(f + a)) OVER (PARTITION BY t)) AS lp FROM eta)"""
HARMONICS = ("c1", "s1", "c2", "s2")


def phased(spark, d):
    cells, genes = composed(spark, d)
    return cells.join(T.placements(spark, d).select("fov", "cell", "theta_deg"), ["fov", "cell"], "left"), genes


def phase_model(spark, d, alpha=None):
    return CS.model_from_phases(*phased(spark, d), alpha)


def harmonics_frame(spark, model):
    rows = [(g, float(a), *map(float, c)) for g, a, c in zip(model.genes, model.intercept, model.coef, strict=True)]
    return spark.createDataFrame(rows, "gene string, a double, " + ", ".join(f"{h} double" for h in HARMONICS))


@query("ring_from_phases", "WITH " + RING_SQL + " SELECT 'gene_' || CAST(k + 1 AS VARCHAR) AS gene, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("a", *HARMONICS)) + " FROM mom")
def ring_from_phases(spark, d):
    m = harmonics_frame(spark, phase_model(spark, d))
    return m.select("gene", *[r(c).alias(c) for c in ("a", *HARMONICS)])


@query("ring_oriented", f"""
WITH {RING_SQL}, top AS (SELECT k, th FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f DESC, t) AS rn FROM eta) WHERE rn = 1),
e AS (SELECT atan2(avg(sin(th)), avg(cos(th))) AS e FROM top WHERE k IN (0, 1)), l AS (SELECT atan2(avg(sin(th)), avg(cos(th))) AS l FROM top WHERE k IN (4, 5)),
o AS (SELECT e AS shift, CASE WHEN (l - e) - 2 * pi() * floor((l - e) / (2 * pi())) > pi() THEN -1 ELSE 1 END AS sgn FROM e, l)
SELECT 'gene_' || CAST(k + 1 AS VARCHAR) AS gene, round(degrees(shift), 4) AS shift_deg, sgn < 0 AS flipped, round(c1 * cos(shift) + s1 * sin(shift), 6) AS c1, round(sgn * (s1 * cos(shift) - c1 * sin(shift)), 6) AS s1,
  round(c2 * cos(2 * shift) + s2 * sin(2 * shift), 6) AS c2, round(sgn * (s2 * cos(2 * shift) - c2 * sin(2 * shift)), 6) AS s2 FROM mom, o""")
def ring_oriented(spark, d):
    """The ring in the frame its early and late genes ask for."""
    m, shift, flip = CF.orient(phase_model(spark, d), EARLY, LATE)
    f = harmonics_frame(spark, m)
    return f.select("gene", r(F.degrees(F.lit(shift)), 4).alias("shift_deg"), F.lit(flip).alias("flipped"), *[r(c).alias(c) for c in HARMONICS])


@query("ring_placement", f"""
WITH {RING_SQL}, ll AS (SELECT fov, cell, t, any_value(th) AS th, sum(lgamma(x + 100 * exp(lp)) - lgamma(100 * exp(lp))) AS ll FROM cnt JOIN lp USING (k) GROUP BY 1, 2, 3),
w AS (SELECT *, max(ll) OVER (PARTITION BY fov, cell) AS mx FROM ll),
q AS (SELECT fov, cell, ln(sum(exp(ll - mx))) + any_value(mx) - ln(72) AS norm, sum(exp(ll - mx) * cos(th)) / sum(exp(ll - mx)) AS c, sum(exp(ll - mx) * sin(th)) / sum(exp(ll - mx)) AS s FROM w GROUP BY 1, 2),
k AS (SELECT fov, cell, sum(x) AS total, lgamma(sum(x) + 1) - sum(lgamma(x + 1)) + lgamma(100) - lgamma(sum(x) + 100) AS const FROM cnt GROUP BY 1, 2),
p AS (SELECT fov, cell, total, degrees(atan2(s, c)) - 360 * floor(degrees(atan2(s, c)) / 360) AS theta_deg, sqrt(c * c + s * s) AS "R", norm + const AS evidence FROM q JOIN k USING (fov, cell)),
ed AS (SELECT list_transform(range(1, 8), lambda i: i) AS ks, quantile_cont(total, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM p WHERE fov < {TRAIN_FOVS}),
b AS (SELECT p.*, evidence / greatest(total, 1) AS fq, len(list_filter(e, lambda v: total >= v)) AS o FROM p, ed),
ref AS (SELECT o, avg(fq) AS mean, stddev_pop(fq) AS sd FROM b WHERE fov < {TRAIN_FOVS} GROUP BY 1 HAVING count(*) > 5)
SELECT fov, cell, total, round(theta_deg, 3) AS theta_deg, round("R", 5) AS "R", round(evidence, 5) AS evidence, round((fq - mean) / (sd + 1e-9), 4) AS fit_z FROM b LEFT JOIN ref USING (o)""")
def ring_placement(spark, d):
    """Build, save, load, place: every cell against a stored version and its training octiles."""
    cells, _ = composed(spark, d)
    cells = cut(cells)
    model = phase_model(spark, d, ALPHA)
    root = f"{ensure_checkpoint_dir(spark)}/rings-{uuid.uuid4().hex}"
    CS.save_model(spark, CS.with_reference(model, cut(CM.place(cells.where(F.col("fov") < TRAIN_FOVS), model))), root)
    stored = CS.load_model(spark, root)
    p = CS.fit_z(CM.place(cells, stored.ring), stored)
    return p.select("fov", "cell", "total", r("theta_deg", 3).alias("theta_deg"), r("R", 5).alias("R"), r("evidence", 5).alias("evidence"), r("fit_z", 4).alias("fit_z"))


@query("dna_direction", """
WITH u AS MATERIALIZED (SELECT theta_deg, area AS v FROM m_placed JOIN m_cells USING (fov, cell) WHERE theta_deg IS NOT NULL AND "R" >= 0.5 AND area > 0),
h AS (SELECT i, coalesce(n, 0) / CAST((SELECT count(*) FROM u) AS DOUBLE) AS w FROM (SELECT unnest(range(72)) AS i) LEFT JOIN (SELECT least(CAST(floor(theta_deg / 5) AS INTEGER), 71) AS i, count(*) AS n FROM u GROUP BY 1) USING (i)),
s AS (SELECT a.i, avg(b.w) AS w FROM h a JOIN h b ON (b.i - a.i + 72 + 2) % 72 <= 4 GROUP BY 1),
c AS (SELECT i, (sum(w) OVER (ORDER BY i) - first(w) OVER (ORDER BY i) / 2) % 1.0 AS tau FROM (SELECT i, w / sum(w) OVER () AS w FROM s)),
t AS (SELECT v, a.tau + (b.tau - a.tau) * (theta_deg / 5 - floor(theta_deg / 5)) AS tau FROM u JOIN c a ON a.i = CAST(floor(theta_deg / 5) AS INTEGER) % 72 JOIN c b ON b.i = (CAST(floor(theta_deg / 5) AS INTEGER) + 1) % 72),
m AS (SELECT greatest(least(CAST(floor(tau * 20) AS INTEGER), 19), 0) AS bin, ln(median(v)) AS m FROM t GROUP BY 1 HAVING count(*) >= 8),
d AS (SELECT coalesce(lead(m) OVER (ORDER BY bin), first(m) OVER (ORDER BY bin)) - m AS step FROM m)
SELECT (SELECT count(*) FROM u) AS n, round(-min(step) / greatest(max(step), 1e-9), 6) AS ratio, -min(step) / greatest(max(step), 1e-9) < 1 AS flip FROM d""")
def dna_direction(spark, d):
    """Steepest fall over steepest rise of the cell areas in cycle time, and whether that mirrors the ring."""
    t = T.placements(spark, d).join(T.cells(spark, d).select("fov", "cell", "area"), ["fov", "cell"]).withColumn("inside", F.col("R"))
    ratio, n = CF.dna_direction(t, "area")
    return spark.createDataFrame([(n, ratio, ratio is not None and ratio < 1)], "n long, ratio double, flip boolean").withColumn("ratio", r("ratio"))


@query("gene_drop_shift", f"""
WITH {RING_SQL}, term AS MATERIALIZED (SELECT fov, cell, t, k, x, x * lp AS v FROM cnt JOIN lp USING (k)),
whole AS MATERIALIZED (SELECT fov, cell, t, sum(v) AS v, sum(x) AS s FROM term GROUP BY 1, 2, 3),
ll AS (SELECT fov, cell, t, -1 AS h, v FROM whole UNION ALL
  SELECT w.fov, w.cell, w.t, e.k, w.v - e.v - (w.s - e.x) * ln(1 - exp(lp)) FROM whole w JOIN term e USING (fov, cell, t) JOIN lp ON lp.k = e.k AND lp.t = e.t WHERE w.s > e.x),
q AS (SELECT fov, cell, h, sum(exp(v - mx) * cos(t * 2 * pi() / 72)) / sum(exp(v - mx)) AS c, sum(exp(v - mx) * sin(t * 2 * pi() / 72)) / sum(exp(v - mx)) AS s
  FROM (SELECT *, max(v) OVER (PARTITION BY fov, cell, h) AS mx FROM ll) GROUP BY 1, 2, 3),
g AS (SELECT a.h, sqrt(a.c * a.c + a.s * a.s) AS "R", abs(degrees(atan2(a.s * b.c - a.c * b.s, a.c * b.c + a.s * b.s))) AS err FROM q a JOIN q b USING (fov, cell) WHERE a.h >= 0 AND b.h = -1)
SELECT 'gene_' || CAST(h + 1 AS VARCHAR) AS gene, count(*) AS n, round(median(err), 4) AS err_deg, round(avg("R"), 5) AS mean_R FROM g GROUP BY 1""")
def gene_drop_shift(spark, d):
    """How far the phases move when each gene in turn is left out."""
    cells, genes = composed(spark, d)
    out = CC.drop_shifts(cells, phase_model(spark, d), list(range(len(genes))))
    return out.select("gene", "n", r("err_deg", 4).alias("err_deg"), r("mean_R", 5).alias("mean_R"))


@query("gene_elimination")
def gene_elimination(spark, d):
    """The order in which genes can go, and the phase shift each loss costs."""
    cells, _ = composed(spark, d)
    steps = CC.backward_elimination(cells, phase_model(spark, d))
    return spark.createDataFrame([tuple(s.values()) for s in steps], "step int, dropped string, n_genes int, err_deg double, mean_R double")


@query("dispersion_choice")
def dispersion_choice(spark, d):
    """Held-out evidence of every concentration over folds of whole fields."""
    cells, genes = composed(spark, d)
    return CC.choose_alpha(cells, genes)


ROLES = {"gene_1": "S", "gene_2": "S", "gene_5": "G2/M", "gene_6": "G2/M"}


@query("arcs_from_profiles", f"""
WITH {RING_SQL}, fold AS (SELECT CASE WHEN k IN (0, 1) THEN 'S' ELSE 'G2/M' END AS role, t, exp(f - m) AS v FROM (SELECT *, avg(f) OVER (PARTITION BY k) AS m FROM eta) WHERE k IN (0, 1, 4, 5)),
c AS (SELECT role, t, avg(v) AS v FROM fold GROUP BY 1, 2), top AS (SELECT role, t AS k FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY v DESC, t) AS rn FROM c) WHERE rn = 1),
s AS (SELECT role, k, min((k - t + 72 - 1) % 72) FILTER (v <= 1) AS o FROM c JOIN top USING (role) GROUP BY 1, 2),
b AS (SELECT max(CASE WHEN role = 'S' THEN (k - o + 72) % 72 * 5.0 END) AS s, max(CASE WHEN role <> 'S' THEN (k - o + 72) % 72 * 5.0 END) AS g FROM s)
SELECT 'G1' AS name, CAST(0 AS DOUBLE) AS start_deg, CAST(s AS DOUBLE) AS end_deg FROM b UNION ALL SELECT 'S', s, g FROM b UNION ALL SELECT 'G2/M', g, 0 FROM b""")
def arcs_from_profiles(spark, d):
    return spark.createDataFrame(AR.arcs_from_profiles(phase_model(spark, d), ROLES), "name string, start_deg double, end_deg double")


@query("arcs_from_dna", """
WITH m AS (SELECT least(CAST(floor(theta_deg / 10) AS INTEGER), 35) AS i, median(area + 600 * theta_deg) AS v FROM m_placed JOIN m_cells USING (fov, cell) WHERE theta_deg IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT a.i, any_value(a.v) AS v, avg(b.v) AS mean FROM m a JOIN m b ON b.i IN (a.i, (a.i + 1) % 36, (a.i + 35) % 36) GROUP BY 1),
l AS (SELECT i AS low, mean AS base FROM s ORDER BY mean, i LIMIT 1), t AS (SELECT max(v) AS top FROM s),
f AS (SELECT min(a.i) AS s FROM s a JOIN s b ON b.i = a.i + 1, l WHERE a.i >= low AND a.v >= base * 1.15 AND b.v >= base * 1.15),
g AS (SELECT coalesce(min(s.i), 35) AS g FROM s, l, t, f WHERE s.i >= f.s AND v >= base + 0.85 * (top - base))
SELECT 'G1' AS name, CAST(0 AS DOUBLE) AS start_deg, s * CAST(10 AS DOUBLE) AS end_deg, round(base, 4) AS g1_level, round(top, 4) AS top FROM f, l, t
UNION ALL SELECT 'S', s * CAST(10 AS DOUBLE), g * CAST(10 AS DOUBLE), round(base, 4), round(top, 4) FROM f, g, l, t UNION ALL SELECT 'G2/M', g * CAST(10 AS DOUBLE), 0, round(base, 4), round(top, 4) FROM g, l, t""")
def arcs_from_dna(spark, d):
    """Arcs from a content that grows with the phase."""
    t = T.placements(spark, d).join(T.cells(spark, d).select("fov", "cell", "area"), ["fov", "cell"]).withColumn("dna", F.col("area") + 600 * F.col("theta_deg"))
    arcs, levels = AR.arcs_from_dna(t, "dna")
    rows = [(a["name"], a["start_deg"], a["end_deg"], levels["g1_level"], levels["top"]) for a in arcs]
    return spark.createDataFrame(rows, "name string, start_deg double, end_deg double, g1_level double, top double").withColumns(
        {c: r(c, 4) for c in ("g1_level", "top")})


# Cells right after division are thinned so that a sparse stretch exists.
@query("post_division_arcs", """
WITH h AS (SELECT CAST(floor(theta_deg / 5 + 0.5) AS INTEGER) % 72 AS i, count(*) AS n FROM m_placed WHERE theta_deg IS NOT NULL AND (theta_deg >= 40 OR cell % 5 = 0) GROUP BY 1),
w AS (SELECT i, coalesce(n, 0) AS n FROM (SELECT unnest(range(72)) AS i) LEFT JOIN h USING (i)),
s AS (SELECT a.i, sum(b.n) / 5.0 AS v FROM w a JOIN w b ON (b.i - a.i + 74) % 72 <= 4 GROUP BY 1), m AS (SELECT median(v) * 0.5 AS m FROM s),
e AS (SELECT CASE WHEN (SELECT v FROM s WHERE i = 0) >= any_value(m) THEN NULL ELSE min(i) FILTER (v >= m) * 5.0 - 2.5 END AS e FROM s, m)
SELECT * FROM (SELECT 'post-M' AS name, CAST(0 AS DOUBLE) AS start_deg, CAST(e AS DOUBLE) AS end_deg FROM e WHERE e > 0 AND e < 150 UNION ALL
  SELECT 'G1', CASE WHEN e > 0 AND e < 150 THEN e ELSE 0 END, 150 FROM e UNION ALL SELECT 'S', 150, 250 UNION ALL SELECT 'G2/M', 250, 0)""")
def post_division_arcs(spark, d):
    t = T.placements(spark, d).where("theta_deg >= 40 or cell % 5 = 0")
    arcs = AR.with_post_division(AR._three(0.0, 150.0, 250.0), AR.phase_density(t))
    return spark.createDataFrame([(a["name"], float(a["start_deg"]), float(a["end_deg"])) for a in arcs], "name string, start_deg double, end_deg double")
