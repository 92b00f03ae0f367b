"""Coordinate frames, assignment, segmentation flags, coverage and plans."""

from pyspark.sql import functions as F

from chromaloom.functions import affine
from chromaloom.functions.scalar import r
from chromaloom.operators import assignment as AS
from chromaloom.operators import frames as FR
from chromaloom.operators import status as ST
from chromaloom.sources import tables as T

from .registry import query


# Coordinates are exact decimals, so a rounding tie is common; the shift makes it fall one way.
TIE = 3.3333e-9


def layered(spark, d):
    return FR.attach_layers(T.spots(spark, d), T.fov_matrices(spark, d), T.bridges(spark, d), T.cell_entries(spark, d), T.anchors(spark, d))


@query("transform_points", """
SELECT fov, uid, cell, round(adj_y + 3.3333e-9, 6) AS adj_y, round(adj_x + 3.3333e-9, 6) AS adj_x, round(adj_z, 6) AS adj_z,
       CASE WHEN coalesce(NOT yx_is_residual, FALSE) THEN 0 ELSE CAST(no_within AS INTEGER) + CASE WHEN no_bridge AND modality <> 'DNA' THEN 1 ELSE 0 END END AS n_missing FROM m_projected""")
def transform_points(spark, d):
    p = FR.project(layered(spark, d), "DNA", ["fov", "uid", "cell"])
    return p.select("fov", "uid", "cell", r(F.col("adj_y") + TIE).alias("adj_y"), r(F.col("adj_x") + TIE).alias("adj_x"), r("adj_z").alias("adj_z"), F.size("missing").alias("n_missing"))


@query("reconcile_shift", """
SELECT modality, count(*) AS n, round(median(s), 5) AS median, round(quantile_cont(s, 0.9), 5) AS p90, round(max(s), 5) AS max
FROM (SELECT modality, sqrt((adj_y - raw_y)*(adj_y - raw_y) + (adj_x - raw_x)*(adj_x - raw_x)) AS s FROM m_projected) GROUP BY 1""")
def reconcile_shift(spark, d):
    """Dry run: how far the current matrices move every spot."""
    p = FR.project(layered(spark, d), "DNA", ["modality", "raw_y", "raw_x"])
    s = FR.shift_stats(p, ("adj_y", "adj_x"), ("raw_y", "raw_x"), ["modality"])
    return s.select("modality", "n", r("median", 5).alias("median"), r("p90", 5).alias("p90"), r("max", 5).alias("max"))


@query("transform_between", """
WITH f AS (SELECT a.fov, a.modality, a.hybe AS src, a.w_yy, a.w_yx, a.w_yt, a.w_xy, a.w_xx, a.w_xt FROM m_within a WHERE modality = 'DNA'),
g AS (SELECT * FROM f WHERE src = 'Hyb_001')
SELECT s.fov, s.src, round((g.w_xx * (s.w_yt - g.w_yt) - g.w_yx * (s.w_xt - g.w_xt)) / (g.w_yy * g.w_xx - g.w_yx * g.w_xy), 6) AS dy,
       round((-g.w_xy * (s.w_yt - g.w_yt) + g.w_yy * (s.w_xt - g.w_xt)) / (g.w_yy * g.w_xx - g.w_yx * g.w_xy), 6) AS dx,
       round(degrees(atan2((-g.w_xy * s.w_yy + g.w_yy * s.w_xy) / (g.w_yy * g.w_xx - g.w_yx * g.w_xy), (g.w_xx * s.w_yy - g.w_yx * s.w_xy) / (g.w_yy * g.w_xx - g.w_yx * g.w_xy))), 6) AS theta_deg
FROM f s JOIN g ON g.fov = s.fov""")
def transform_between(spark, d):
    """Every DNA round into the frame of round 1 of its FOV."""
    rounds = T.fov_matrices(spark, d).where("modality = 'DNA'").select("fov", "modality", "hybe")
    lay = FR.attach_layers(rounds.withColumn("cell", F.lit(-1).cast("long")), T.fov_matrices(spark, d), T.bridges(spark, d))
    home = lay.where("hybe = 'Hyb_001'").select("fov", *[c for c in lay.columns if c != "fov"])
    dst = lay.select("fov", F.col("hybe").alias("src")).join(home, "fov")
    one = FR.transform_between(lay.withColumn("src", F.col("hybe")), dst, ["fov", "src"], "DNA")
    return one.select("fov", "src", r("h.yt").alias("dy"), r("h.xt").alias("dx"), r(affine.of("h").theta_deg()).alias("theta_deg"))


@query("alignment_bounds", """
SELECT fov, modality, hybe, abs(w_yy*32 + w_yx*64 + w_yt - 32) <= 4 AND abs(w_xy*32 + w_xx*64 + w_xt - 64) <= 4 AND abs(degrees(atan2(w_xy, w_yy))) <= 10 AS within FROM m_within""")
def alignment_bounds(spark, d):
    h, w = T.FRAME_SHAPE
    return T.fov_matrices(spark, d).select("fov", "modality", "hybe", affine.of("h_within").within_bounds(h, w, 4.0, 10.0).alias("within"))


@query("z_consensus", """
WITH e AS (SELECT CAST(l_orderkey % 25 AS INTEGER) AS fov, l_orderkey AS cell, CASE WHEN l_linestatus = 'F' THEN 'DNA' ELSE 'RNA' END AS modality,
           'Hyb_00' || CAST(l_linenumber AS VARCHAR) AS hybe, l_partkey, l_suppkey, l_quantity - 25 AS dz, l_returnflag = 'R' AS z_rejected FROM lineitem),
m AS (SELECT fov, modality, hybe, count(*) AS n, median(dz) AS c FROM e WHERE NOT z_rejected GROUP BY 1, 2, 3)
SELECT e.fov, cell, e.modality, e.hybe, l_partkey, l_suppkey, CASE WHEN z_rejected AND coalesce(n >= 8 AND c <> 0, FALSE) THEN c ELSE dz END AS dz_used,
       z_rejected AND coalesce(n >= 8 AND c <> 0, FALSE) AS imputed FROM e LEFT JOIN m ON m.fov = e.fov AND m.modality = e.modality AND m.hybe = e.hybe""")
def z_consensus(spark, d):
    li = T.table(spark, d, "lineitem")
    e = li.select((F.col("l_orderkey") % T.N_FOV).cast("int").alias("fov"), F.col("l_orderkey").alias("cell"),
                  F.when(F.col("l_linestatus") == "F", "DNA").otherwise("RNA").alias("modality"),
                  F.concat(F.lit("Hyb_00"), F.col("l_linenumber").cast("string")).alias("hybe"), "l_partkey", "l_suppkey",
                  (F.col("l_quantity") - 25).alias("dz"), (F.col("l_returnflag") == "R").alias("z_rejected"))
    return FR.z_consensus(e).select("fov", "cell", "modality", "hybe", "l_partkey", "l_suppkey", "dz_used", "imputed")


@query("assign_spots", """
WITH own AS (SELECT fov, y, x, max(cell) AS owner FROM m_pixels WHERE y >= 0 AND x >= 0 AND y < 64 AND x < 128 GROUP BY 1, 2, 3)
SELECT s.fov, s.uid, s.cell, coalesce(o.owner, -1) AS owner FROM m_spots s LEFT JOIN own o ON o.fov = s.fov AND o.y = CAST(trunc(s.raw_y) AS INTEGER) AND o.x = CAST(trunc(s.raw_x) AS INTEGER)""")
def assign_spots(spark, d):
    return AS.assign_spots(T.spots(spark, d), T.mask_pixels(T.cells(spark, d)), *T.FRAME_SHAPE).select("fov", "uid", "cell", "owner")


FLAGS_SQL = """
SELECT c.fov, c.cell, c.area / CASE WHEN f.med = 0 THEN 1 ELSE f.med END AS area_rel, CASE WHEN f.sd > 0 THEN (c.mean_stain - f.mu) / f.sd ELSE 0 END AS stain_z, c.solidity,
       min_y < 5 OR min_x < 5 OR max_y >= 59 OR max_x >= 123 AS border
FROM m_cells c JOIN m_maskstats k ON k.fov = c.fov AND k.cell = c.cell JOIN (SELECT fov, median(area) AS med, avg(mean_stain) AS mu, stddev_pop(mean_stain) AS sd FROM m_cells GROUP BY 1) f ON f.fov = c.fov"""


def flags(spark, d):
    cells = T.cells(spark, d)
    extent = AS.mask_stats(T.mask_pixels(cells)).select("fov", "cell", "min_y", "max_y", "min_x", "max_x")
    return AS.segmentation_flags(cells.select("fov", "cell", "area", "mean_stain", "solidity").join(extent, ["fov", "cell"]), *T.FRAME_SHAPE)


@query("seg_flags", f"""
SELECT fov, cell, round(area_rel, 6) AS area_rel, round(stain_z, 6) AS stain_z, area_rel < 0.5 AS small, area_rel > 2 AS large, solidity < 0.9 AS irregular,
       stain_z < -1.5 AS dim, stain_z > 3 AS bright, border FROM ({FLAGS_SQL})""")
def seg_flags(spark, d):
    return flags(spark, d).select("fov", "cell", r("area_rel").alias("area_rel"), r("stain_z").alias("stain_z"), *AS.FLAGS)


@query("seg_drop", f"SELECT fov, cell FROM ({FLAGS_SQL}) WHERE NOT (border OR area_rel > 2 OR stain_z < -1.5)")
def seg_drop(spark, d):
    return AS.drop_flagged(flags(spark, d), "border, large, dim").select("fov", "cell")


LOC_SQL = """
loc AS (SELECT e.fov, e.modality, count(s.fov) AS have, count(*) AS want FROM (
    SELECT f.fov, l.modality, l.hybe, c.channel FROM (SELECT DISTINCT fov FROM m_cells) f CROSS JOIN m_layout l CROSS JOIN (VALUES (488), (555), (635)) c(channel)
    WHERE c.channel <> l.fiducial_channel OR l.hybe_num = 1) e
  LEFT JOIN (SELECT DISTINCT fov, modality, hybe, channel FROM m_spots WHERE NOT (fov >= 20 AND hybe = 'Hyb_003') AND fov <> 24) s
  ON s.fov = e.fov AND s.modality = e.modality AND s.hybe = e.hybe AND s.channel = e.channel GROUP BY 1, 2),
ali AS (SELECT f.fov, l.modality, count(w.fov) AS have, count(*) AS want FROM (SELECT DISTINCT fov FROM m_cells) f CROSS JOIN m_layout l
  LEFT JOIN m_within w ON w.fov = f.fov AND w.modality = l.modality AND w.hybe = l.hybe WHERE l.hybe_num <> 1 GROUP BY 1, 2),
typ AS (SELECT fov, 'all' AS modality, count(*) FILTER (celltype <> '') AS have, count(*) AS want FROM m_cells GROUP BY 1),
parts AS (SELECT 'localization' AS step, * FROM loc UNION ALL SELECT 'fov_alignment', * FROM ali UNION ALL SELECT 'celltype', * FROM typ),
st AS (SELECT *, CASE WHEN want <= 0 THEN 3 WHEN have >= want THEN 2 WHEN have > 0 THEN 1 ELSE 0 END AS k FROM parts),
status AS (SELECT step, fov, CAST(sum(have) AS BIGINT) AS have, CAST(sum(want) AS BIGINT) AS want, CASE min(k) WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' WHEN 2 THEN 'done' ELSE 'n/a' END AS state FROM st GROUP BY 1, 2)"""


def status_of(spark, d):
    """Coverage of three steps: expected items by set logic against what the tables hold."""
    fovs = T.cells(spark, d).select("fov").distinct()
    lay = T.layout(spark, d).select("modality", "hybe", "hybe_num", "fiducial_channel")
    # one row per (FOV, modality, round): bounded by the layout, joined on a constant-free key list
    rounds = fovs.withColumn("modality", F.explode(F.array(F.lit("DNA"), F.lit("RNA")))).join(lay, "modality")
    targets = rounds.select("*", F.explode(F.array(*[F.lit(c) for c in sorted(T.CHANNELS.values())])).alias("channel")).where(
        "channel <> fiducial_channel or hybe_num = 1").select("fov", "modality", "hybe", "channel")
    present = T.spots(spark, d).where("not (fov >= 20 and hybe = 'Hyb_003') and fov <> 24")
    loc = ST.coverage(targets, present, ["fov", "modality"], ["hybe", "channel"])
    ali = ST.coverage(rounds.where("hybe_num <> 1").select("fov", "modality", "hybe"), T.fov_matrices(spark, d), ["fov", "modality"], ["hybe"])
    typ = T.cells(spark, d).groupBy("fov").agg(F.sum((F.col("celltype") != "").cast("long")).alias("have"), F.count(F.lit(1)).alias("want")).select(
        "fov", F.lit("all").alias("modality"), "have", "want").withColumn("state", ST.state("have", "want"))
    steps = [loc.withColumn("step", F.lit("localization")), ali.withColumn("step", F.lit("fov_alignment")), typ.withColumn("step", F.lit("celltype"))]
    return ST.worst_of(steps[0].unionByName(steps[1]).unionByName(steps[2]), ["step", "fov"])


@query("status_states", f"WITH {LOC_SQL} SELECT step, fov, have, want, state FROM status")
def status_states(spark, d):
    return status_of(spark, d)


@query("status_summary", f"""WITH {LOC_SQL} SELECT step, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'partial') AS partial,
count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'n/a') AS n_a FROM status GROUP BY 1""")
def status_summary(spark, d):
    return ST.summarize(status_of(spark, d))


@query("plan_existing", f"""WITH {LOC_SQL} SELECT step, fov FROM status WHERE (step = 'fov_alignment' AND state <> 'n/a') OR (step = 'localization' AND state IN ('partial', 'missing'))""")
def plan_existing(spark, d):
    return ST.plan(status_of(spark, d), {"fov_alignment": "redo", "celltype": "skip"})


@query("pending_rounds", """
SELECT f.fov, l.modality, l.hybe FROM (SELECT DISTINCT fov FROM m_cells) f CROSS JOIN m_layout l
WHERE (f.fov, l.modality, l.hybe) NOT IN (SELECT fov, modality, hybe FROM m_spots WHERE brightness > 103500)""")
def pending_rounds(spark, d):
    fovs = T.cells(spark, d).select("fov").distinct().withColumn("modality", F.explode(F.array(F.lit("DNA"), F.lit("RNA"))))
    want = fovs.join(T.layout(spark, d).select("modality", "hybe"), "modality").select("fov", "modality", "hybe")
    return ST.pending(want, T.spots(spark, d).where("brightness > 103500"), ["fov", "modality", "hybe"])
