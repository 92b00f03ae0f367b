"""Expression tables, pair distances, collapses and histograms."""

from pyspark.sql import functions as F

from chromaloom.functions.scalar import r
from chromaloom.operators import distances as D
from chromaloom.operators import expression as E
from chromaloom.operators import clusters as CL
from chromaloom.operators import sites
from chromaloom.operators.gate import CelltypeIn, Condition
from chromaloom.session import cut
from chromaloom.sources import tables as T

from .common import DNA, RNA, SOURCES, polymer_of, population
from .registry import query

EXPR_COLS = ["fov", "cell", "celltype", "modality", "hybe", "channel"]
SELF_PAIRS = """
SELECT a.fov, a.cell, a.uid AS point_a, b.uid AS point_b, sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um)) AS d_um
FROM m_spots a JOIN m_spots b ON a.fov = b.fov AND a.cell = b.cell AND a.uid < b.uid
WHERE a.cell >= 0 AND a.modality = 'DNA' AND b.modality = 'DNA' AND a.z_status <> 'rejected' AND b.z_status <> 'rejected'"""


def points(spark, d, source, dims="xyz"):
    return D.points_of(source, T.spots(spark, d), dims=dims)


@query("expression_table", """
SELECT fov, cell, celltype, modality, hybe, channel, n_spots, round(brightness_median, 4) AS brightness_median,
       round(brightness_total, 3) AS brightness_total FROM m_expr""")
def expression_table(spark, d):
    t = E.expression_table(T.cells(spark, d), T.spots(spark, d), SOURCES)
    return t.select(*EXPR_COLS, "n_spots", r("brightness_median", 4).alias("brightness_median"), r("brightness_total", 3).alias("brightness_total"))


@query("modality_denominators", """
SELECT fov, cell, modality, mod_n_spots, round(mod_brightness_median, 4) AS mod_brightness_median,
       round(mod_brightness_total, 3) AS mod_brightness_total FROM m_denom""")
def modality_denominators(spark, d):
    t = E.modality_denominators(T.spots(spark, d))
    return t.select("fov", "cell", "modality", "mod_n_spots", r("mod_brightness_median", 4).alias("mod_brightness_median"),
                    r("mod_brightness_total", 3).alias("mod_brightness_total"))


@query("expression_norm_by_modality", """
SELECT e.fov, e.cell, e.modality, e.hybe, e.channel, round(e.brightness_median / nullif(n.mod_brightness_median, 0), 6) AS brightness_median_norm
FROM m_expr e LEFT JOIN m_denom n ON n.cell = e.cell AND n.modality = e.modality""")
def expression_norm_by_modality(spark, d):
    pop = population(spark, d, "expression", "denominators")
    t = E.normalize(pop.expression, "brightness_median", "by_modality", denominators=pop.denominators)
    return t.select("fov", "cell", "modality", "hybe", "channel", r("brightness_median_norm").alias("brightness_median_norm"))


@query("expression_norm_by_source", """
SELECT e.fov, e.cell, e.modality, e.hybe, e.channel, round(e.brightness_total / nullif(f.brightness_total, 0), 6) AS brightness_total_norm
FROM m_expr e LEFT JOIN m_expr f ON f.cell = e.cell AND f.modality = 'RNA' AND f.hybe = 'Hyb_002' AND f.channel = 555""")
def expression_norm_by_source(spark, d):
    t = E.normalize(population(spark, d, "expression").expression, "brightness_total", "by_source", ("RNA", "Hyb_002", 555))
    return t.select("fov", "cell", "modality", "hybe", "channel", r("brightness_total_norm").alias("brightness_total_norm"))


@query("mask_intensity", """
WITH img AS (SELECT fov, CAST(raw_y AS INTEGER) AS y, CAST(trunc(raw_x) AS INTEGER) AS x, max(brightness) AS value FROM m_spots WHERE modality = 'RNA' AND brightness IS NOT NULL GROUP BY 1, 2, 3)
SELECT p.fov, p.cell, round(median(value), 4) AS mask_median FROM m_pixels p JOIN img USING (fov, y, x) GROUP BY 1, 2""")
def mask_intensity(spark, d):
    s = T.spots(spark, d).where("modality = 'RNA' and brightness is not null")
    image = s.groupBy("fov", F.col("raw_y").cast("int").alias("y"), F.col("raw_x").cast("int").alias("x")).agg(F.max("brightness").alias("value"))
    return E.mask_intensity(T.mask_pixels(T.cells(spark, d)), image, T.FRAME_SHAPE).select("fov", "cell", r("mask_median", 4).alias("mask_median"))


@query("pair_distances_xyz", "SELECT fov, cell, point_a, point_b, round(d_um, 6) AS d_um FROM m_pairs")
def pair_distances_xyz(spark, d):
    p = D.pair_distances(points(spark, d, RNA), points(spark, d, DNA))
    return p.withColumn("d_um", r("d_um"))


@query("pair_self_distances_xy", f"SELECT fov, cell, point_a, point_b, round(d_um, 6) AS d_um FROM ({SELF_PAIRS})")
def pair_self_distances_xy(spark, d):
    return D.pair_distances(points(spark, d, DNA, "xy"), dims="xy").withColumn("d_um", r("d_um"))


@query("pair_distance_one_source", """
SELECT a.fov, a.cell, a.uid AS point_a, b.uid AS point_b,
       round(sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um) + (a.z_um-b.z_um)*(a.z_um-b.z_um)), 6) AS d_um
FROM m_spots a JOIN m_spots b ON a.fov = b.fov AND a.cell = b.cell WHERE a.cell >= 0 AND a.z_status = 'accepted' AND b.z_status = 'accepted'
AND a.modality = 'RNA' AND a.hybe = 'Hyb_002' AND a.channel = 555 AND b.modality = 'DNA' AND b.hybe = 'Hyb_004' AND b.channel = 555""")
def pair_distance_one_source(spark, d):
    p = D.pair_distances(points(spark, d, ["RNA", "Hyb_002", 555]), points(spark, d, ["DNA", "Hyb_004", 555]))
    return p.withColumn("d_um", r("d_um"))


@query("pair_distance_per_cell", "SELECT fov, cell, count(*) AS n, round(median(d_um), 6) AS d_um FROM m_pairs GROUP BY 1, 2")
def pair_distance_per_cell(spark, d):
    return D.per_cell(points(spark, d, RNA), points(spark, d, DNA)).select("fov", "cell", "n", r("d_um").alias("d_um"))


@query("pair_distance_min", "SELECT fov, cell, count(*) AS n, round(min(d_um), 6) AS d_um FROM m_pairs GROUP BY 1, 2")
def pair_distance_min(spark, d):
    return D.per_cell(points(spark, d, RNA), points(spark, d, DNA), "min").select("fov", "cell", "n", r("d_um").alias("d_um"))


@query("traced_distances", """
SELECT a.fov, a.cell, a.uid AS point_a, p.allele_id AS point_b,
       round(sqrt((a.y_um-p.y_um)*(a.y_um-p.y_um) + (a.x_um-p.x_um)*(a.x_um-p.x_um) + (a.z_um-p.z_um)*(a.z_um-p.z_um)), 6) AS d_um
FROM m_spots a JOIN m_polymer p ON a.fov = p.fov AND a.cell = p.cell WHERE a.cell >= 0 AND a.z_status = 'accepted' AND a.modality = 'RNA' AND p.slot = 1""")
def traced_distances(spark, d):
    b = D.traced_points(polymer_of(spark, d), 1)
    return D.pair_distances(points(spark, d, RNA), b).withColumn("d_um", r("d_um"))


@query("distance_histogram", """
SELECT CASE WHEN celltype = '' THEN 'Unassigned' ELSE celltype END AS celltype, least(CAST(floor(d_um * 100 / 20.0) AS INTEGER), 99) AS bin, count(*) AS n
FROM m_pairs p JOIN m_cells c ON c.cell = p.cell WHERE celltype IN ('1-URGENT', '') AND d_um BETWEEN 0 AND 20 GROUP BY 1, 2""")
def distance_histogram(spark, d):
    pop = population(spark, d)
    gate = Condition([CelltypeIn(["1-URGENT", ""])]).cell_flags(pop).where("gated")
    pairs = D.pair_distances(points(spark, d, RNA), points(spark, d, DNA))
    return D.histogram(pairs, 0.0, 20.0, 100, gate, pop.cells)


def bin_points(spark, d):
    """Traced-round spots of every cell, each with its bin."""
    s = T.spots(spark, d).where("cell >= 0")
    return s.select("fov", "cell", F.col("uid").alias("point"), "y_um", "x_um", "z_um", F.col("hybe").alias("bin"))


SUPPORT = """
SELECT a.fov, a.cell, a.uid AS point, a.y_um, a.x_um, a.z_um, count(DISTINCT b.hybe) AS support FROM m_spots a JOIN m_spots b
ON a.fov = b.fov AND a.cell = b.cell AND sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um) + (a.z_um-b.z_um)*(a.z_um-b.z_um)) <= 4.0
WHERE a.cell >= 0 GROUP BY 1, 2, 3, 4, 5, 6"""


def _rounds(order: str, k: int, source: str, g: str = "g", b: str = "b", opening: str = "WITH ") -> str:
    """k greedy rounds as chained CTEs: best point per cell, then drop its neighbourhood."""
    out = [f"{g}0 AS ({source})"]
    for n in range(k):
        out.append(f"{b}{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell ORDER BY {order}) AS rn FROM {g}{n}) WHERE rn = 1)")
        out.append(f"""{g}{n + 1} AS (SELECT g.* FROM {g}{n} g JOIN {b}{n} b ON b.fov = g.fov AND b.cell = g.cell
WHERE sqrt((g.y_um-b.y_um)*(g.y_um-b.y_um) + (g.x_um-b.x_um)*(g.x_um-b.x_um) + (g.z_um-b.z_um)*(g.z_um-b.z_um)) > 4.0)""")
    return opening + ",\n".join(out)


@query("radius_support", f"SELECT fov, cell, point, support FROM ({SUPPORT})")
def radius_support(spark, d):
    return D.radius_support(bin_points(spark, d), 4.0)


@query("allele_multiplicity", _rounds("support DESC, point", 3, f"SELECT * FROM ({SUPPORT}) WHERE support >= 2") + """
SELECT fov, cell, coalesce(k, 0) AS k FROM (SELECT DISTINCT fov, cell FROM m_spots WHERE cell >= 0) LEFT JOIN
(SELECT fov, cell, count(*) AS k FROM (SELECT fov, cell FROM b0 UNION ALL SELECT fov, cell FROM b1 UNION ALL SELECT fov, cell FROM b2) GROUP BY 1, 2) USING (fov, cell)""")
def allele_multiplicity(spark, d):
    return sites.spatial_multiplicity(bin_points(spark, d), T.N_SLOTS, radius=4.0)


@query("supported_seeds", _rounds("support DESC, far DESC, point", 2, f"""
SELECT s.*, round(sqrt((y_um-cy)*(y_um-cy) + (x_um-cx)*(x_um-cx) + (z_um-cz)*(z_um-cz)), 9) AS far FROM ({SUPPORT}) s
JOIN (SELECT fov, cell, avg(y_um) AS cy, avg(x_um) AS cx, avg(z_um) AS cz FROM m_spots WHERE cell >= 0 GROUP BY 1, 2) c USING (fov, cell) WHERE support >= 2""") + """
SELECT fov, cell, 0 AS site, point FROM b0 UNION ALL SELECT fov, cell, 1, point FROM b1""")
def supported_seeds(spark, d):
    return sites.seeds(bin_points(spark, d), 2, 4.0, 2).select("fov", "cell", "site", "point")


# Sites as proposed by allele_multiplicity, points live by support, seeds by support and distance
# from the cell's centre, then fifty passes of nearest centre and mean.
GAP = "sqrt((p.y_um-{c}.y_um)*(p.y_um-{c}.y_um) + (p.x_um-{c}.x_um)*(p.x_um-{c}.x_um) + (p.z_um-{c}.z_um)*(p.z_um-{c}.z_um))"
CLUSTERS_SQL = f"""WITH RECURSIVE pts AS MATERIALIZED (SELECT fov, cell, uid AS point, hybe AS slot, y_um, x_um, z_um FROM m_spots WHERE cell >= 0),
sup AS MATERIALIZED ({SUPPORT}),
{_rounds("support DESC, point", 3, "SELECT * FROM sup WHERE support >= 2", opening="")},
kk AS MATERIALIZED (SELECT fov, cell, count(*) AS k FROM (SELECT fov, cell FROM b0 UNION ALL SELECT fov, cell FROM b1 UNION ALL SELECT fov, cell FROM b2) GROUP BY 1, 2),
live AS MATERIALIZED (SELECT p.* FROM pts p JOIN sup USING (fov, cell, point) JOIN kk USING (fov, cell) WHERE support >= 2 AND k > 1),
sup2 AS MATERIALIZED (SELECT p.fov, p.cell, p.point, p.y_um, p.x_um, p.z_um, count(DISTINCT c.slot) AS support FROM live p JOIN live c ON c.fov = p.fov AND c.cell = p.cell AND {GAP.format(c="c")} <= 4.0 GROUP BY ALL),
far AS MATERIALIZED (SELECT p.*, round({GAP.format(c="c")}, 9) AS far FROM sup2 p JOIN (SELECT fov, cell, avg(y_um) AS y_um, avg(x_um) AS x_um, avg(z_um) AS z_um FROM live GROUP BY 1, 2) c USING (fov, cell) WHERE support >= 2),
{_rounds("support DESC, far DESC, point", 3, "SELECT * FROM far", "h", "s", "")},
start AS MATERIALIZED (SELECT f.* FROM (SELECT fov, cell, 0 AS site, y_um, x_um, z_um FROM s0 UNION ALL SELECT fov, cell, 1, y_um, x_um, z_um FROM s1 UNION ALL SELECT fov, cell, 2, y_um, x_um, z_um FROM s2) f
  JOIN kk USING (fov, cell) WHERE site < k),
km AS (SELECT 0 AS it, * FROM start UNION ALL
  SELECT it + 1, fov, cell, site, coalesce(avg(py) FILTER (rn = 1), any_value(y_um)), coalesce(avg(px) FILTER (rn = 1), any_value(x_um)), coalesce(avg(pz) FILTER (rn = 1), any_value(z_um)) FROM (
    SELECT c.*, p.y_um AS py, p.x_um AS px, p.z_um AS pz, row_number() OVER (PARTITION BY p.fov, p.cell, p.point ORDER BY {GAP.format(c="c")}, site) AS rn
    FROM km c JOIN live p ON p.fov = c.fov AND p.cell = c.cell WHERE it < 50) GROUP BY it, fov, cell, site),
ctr AS MATERIALIZED (SELECT * FROM km WHERE it = 50),
lab AS MATERIALIZED (SELECT * FROM (SELECT p.*, site, row_number() OVER (PARTITION BY p.fov, p.cell, p.point ORDER BY {GAP.format(c="c")}, site) AS rn FROM live p JOIN ctr c USING (fov, cell)) WHERE rn = 1),
wide AS MATERIALIZED (SELECT fov, cell, site, row_number() OVER (PARTITION BY fov, cell ORDER BY site) - 1 AS renamed FROM (SELECT fov, cell, site FROM lab GROUP BY 1, 2, 3 HAVING count(DISTINCT slot) >= 2)),
labels AS MATERIALIZED (SELECT l.fov, l.cell, l.point, l.slot, l.y_um, l.x_um, l.z_um, renamed AS site FROM lab l JOIN wide USING (fov, cell, site)
  UNION ALL SELECT p.*, 0 FROM pts p JOIN kk USING (fov, cell) WHERE k = 1),
centres AS MATERIALIZED (SELECT fov, cell, renamed AS site, c.y_um, c.x_um, c.z_um FROM ctr c JOIN wide USING (fov, cell, site)
  UNION ALL SELECT fov, cell, 0, avg(y_um), avg(x_um), avg(z_um) FROM labels JOIN kk USING (fov, cell) WHERE k = 1 GROUP BY 1, 2)"""


def clusters_of(spark, d):
    points = T.spots(spark, d).where("cell >= 0").select(
        "fov", "cell", F.col("uid").alias("point"), "y_um", "x_um", "z_um", F.col("hybe").alias("slot"))
    proposed = cut(sites.spatial_multiplicity(points.withColumn("bin", F.col("slot")), T.N_SLOTS, radius=4.0))
    return points, proposed, *CL.site_clusters(points, proposed, 4.0, 2)


@query("site_clusters", CLUSTERS_SQL + """
SELECT fov, cell, site, count(point) AS n, count(DISTINCT slot) AS bins, sum(point % 1009) AS digest, round(any_value(c.y_um), 9) AS y_um, round(any_value(c.x_um), 9) AS x_um
FROM centres c JOIN labels l USING (fov, cell, site) GROUP BY 1, 2, 3""")
def site_clusters(spark, d):
    """Which site each point belongs to, as site sizes, a digest of the members and the centres."""
    _, _, labels, centres = clusters_of(spark, d)
    at = centres.select("fov", "cell", "site", r("y_um", 9).alias("y_um"), r("x_um", 9).alias("x_um"))
    per = labels.groupBy("fov", "cell", "site").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("bins"), F.sum(F.col("point") % 1009).alias("digest"))
    return per.join(at, ["fov", "cell", "site"])


@query("site_separation", CLUSTERS_SQL + """,
per AS (SELECT fov, cell, max(CASE WHEN n - bins > 0.15 * n THEN 1 ELSE 0 END) AS rep FROM (SELECT fov, cell, site, count(*) AS n, count(DISTINCT slot) AS bins FROM labels GROUP BY 1, 2, 3) GROUP BY 1, 2),
gaps AS (SELECT p.fov, p.cell, min(sqrt((p.y_um-c.y_um)*(p.y_um-c.y_um) + (p.x_um-c.x_um)*(p.x_um-c.x_um))) AS gap FROM centres p JOIN centres c ON c.fov = p.fov AND c.cell = p.cell AND p.site < c.site GROUP BY 1, 2),
v AS (SELECT a.fov, a.cell, coalesce(k, 0) AS k, coalesce(n, 0) AS found, gap, rep FROM (SELECT DISTINCT fov, cell FROM pts) a LEFT JOIN kk USING (fov, cell)
  LEFT JOIN (SELECT fov, cell, count(*) AS n FROM centres GROUP BY 1, 2) USING (fov, cell) LEFT JOIN gaps USING (fov, cell) LEFT JOIN per USING (fov, cell))
SELECT fov, cell, k, found, round(gap, 5) AS gap_um, CASE WHEN k < 1 THEN 'none_proposed' WHEN found <> k THEN 'unsupported' WHEN k > 1 AND gap < 2 THEN 'close' WHEN rep = 1 THEN 'repeats' WHEN k = 1 THEN 'single' ELSE 'separated' END AS reason FROM v""")
def site_separation(spark, d):
    """Whether each cell is simply split, and the first reason against it."""
    _, proposed, labels, centres = clusters_of(spark, d)
    return CL.separation_verdicts(proposed, labels, centres).select("fov", "cell", F.col("k").cast("long").alias("k"), "found", r("gap_um", 5).alias("gap_um"), "reason")


@query("one_spot_per_slot", CLUSTERS_SQL + f""",
d AS MATERIALIZED (SELECT p.fov, p.cell, p.slot, p.point, site, {GAP.format(c="c")} AS d FROM pts p JOIN centres c USING (fov, cell)),
nk AS (SELECT fov, cell, slot, least(count(DISTINCT site), count(DISTINCT point)) AS m FROM d GROUP BY 1, 2, 3),
opt AS (SELECT fov, cell, slot, -1 AS site, []::BIGINT[] AS points, []::BIGINT[] AS sites, CAST(0 AS DOUBLE) AS cost, m FROM nk
  UNION ALL SELECT o.fov, o.cell, o.slot, o.site + 1, CASE WHEN d.point IS NULL THEN o.points ELSE list_append(o.points, d.point) END,
    CASE WHEN d.point IS NULL THEN o.sites ELSE list_append(o.sites, d.site) END, o.cost + coalesce(d.d, 0), m
  FROM opt o JOIN (SELECT fov, cell, slot, point, site, d FROM d WHERE d <= 6.0 UNION ALL SELECT fov, cell, slot, NULL, s.site, NULL FROM nk, (SELECT unnest(range(3)) AS site) s) d
    ON d.fov = o.fov AND d.cell = o.cell AND d.slot = o.slot AND d.site = o.site + 1 WHERE d.point IS NULL OR NOT list_contains(o.points, d.point)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell, slot ORDER BY cost, points, sites) AS rn FROM opt WHERE site = 2 AND len(points) = m) WHERE rn = 1),
taken AS (SELECT fov, cell, slot, unnest(points) AS point, unnest(sites) AS site FROM best)
SELECT t.fov, t.cell, t.slot, t.point, t.site, round(d.d, 5) AS distance, l.site IS DISTINCT FROM t.site AS moved
FROM taken t JOIN d USING (fov, cell, slot, point, site) LEFT JOIN labels l ON l.fov = t.fov AND l.cell = t.cell AND l.point = t.point""")
def one_spot_per_slot(spark, d):
    """The point every site takes in every slot, no farther than 6 um."""
    points, _, labels, centres = clusters_of(spark, d)
    out = CL.one_per_slot(points, centres, labels, max_um=6.0)
    return out.select("fov", "cell", "slot", "point", F.col("site").cast("long").alias("site"), r("distance", 5).alias("distance"), "moved")
