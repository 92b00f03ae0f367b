"""Flat export sheets."""

from pyspark.sql import functions as F

from chromaloom.functions.scalar import r
from chromaloom.operators import assignment as AS
from chromaloom.operators import export as X
from chromaloom.operators import frames as FR
from chromaloom.operators import polymer
from chromaloom.session import checked_broadcast
from chromaloom.sources import tables as T

from .registry import query

UM = ("raw_x_um", "raw_y_um", "raw_z_um", "adj_x_um", "adj_y_um", "adj_z_um")
SPOTS_SQL = """
SELECT 'F' || lpad(CAST(s.fov AS VARCHAR), 3, '0') || '-U' || CAST(s.uid AS VARCHAR) AS spot_key, s.fov, s.modality, s.hybe, l.readout_name, l.datatype, l.readout_id, s.channel,
       CASE WHEN l.fiducial_channel = s.channel THEN 'fiducial' ELSE 'readout' END AS channel_role, s.cell,
       CASE WHEN s.cell < 0 THEN '' ELSE 'F' || lpad(CAST(s.fov AS VARCHAR), 3, '0') || '-C' || CAST(s.cell AS VARCHAR) END AS cell_key,
       coalesce(c.celltype, '') AS celltype, s.uid, raw_x, raw_y, raw_z, brightness, p_exist, z_status,
       CASE WHEN p_exist IS NOT NULL AND z_status = 'accepted' THEN 'learned' ELSE '' END AS engine,
       round(raw_x * CAST(0.208 AS DOUBLE), 6) AS raw_x_um, round(raw_y * CAST(0.208 AS DOUBLE), 6) AS raw_y_um, round(raw_z * CAST(0.2 AS DOUBLE), 6) AS raw_z_um
FROM m_spots s LEFT JOIN m_layout l ON l.modality = s.modality AND l.hybe = s.hybe LEFT JOIN m_cells c ON c.fov = s.fov AND c.cell = s.cell"""


def spot_sheet(spark, d):
    return X.spot_rows(T.spots(spark, d), T.cells(spark, d), T.layout(spark, d))


@query("spot_rows", SPOTS_SQL)
def spot_rows(spark, d):
    s = spot_sheet(spark, d).drop("adj_x", "adj_y", "adj_z", "adj_x_um", "adj_y_um", "adj_z_um")
    return s.withColumns({c: r(c) for c in UM if c.startswith("raw")})


CELLS_SQL = """
SELECT 'F' || lpad(CAST(c.fov AS VARCHAR), 3, '0') || '-C' || CAST(c.cell AS VARCHAR) AS cell_key, c.fov, c.cell, c.celltype, k.px AS nucleus_px, round(k.um2, 6) AS nucleus_um2,
       round(k.centroid_x, 6) AS nucleus_centroid_x, round(k.centroid_y, 6) AS nucleus_centroid_y, min_x <= 0 OR min_y <= 0 OR max_x >= 127 OR max_y >= 63 AS touches_frame_edge,
       coalesce(s.n, 0) AS n_spots, coalesce(s.m, 0) AS n_spots_readout, coalesce(a.n, 0) AS n_alleles, p.theta_deg AS cellcycle_theta_deg, p."R" AS "cellcycle_R", c.area, c.mean_stain
FROM m_cells c LEFT JOIN m_maskstats k ON k.fov = c.fov AND k.cell = c.cell LEFT JOIN (
  SELECT s.fov, s.cell, count(*) AS n, count(*) FILTER (s.channel <> l.fiducial_channel) AS m FROM m_spots s JOIN m_layout l ON l.modality = s.modality AND l.hybe = s.hybe
  WHERE s.cell >= 0 GROUP BY 1, 2) s ON s.fov = c.fov AND s.cell = c.cell
LEFT JOIN (SELECT fov, cell, count(*) AS n FROM m_alleles WHERE cell >= 0 GROUP BY 1, 2) a ON a.fov = c.fov AND a.cell = c.cell
LEFT JOIN m_placed p ON p.fov = c.fov AND p.cell = c.cell"""
CELL_EXPORT = ["cell_key", "fov", "cell", "celltype", "nucleus_px", "nucleus_um2", "nucleus_centroid_x", "nucleus_centroid_y", "touches_frame_edge",
               "n_spots", "n_spots_readout", "n_alleles", "cellcycle_theta_deg", "cellcycle_R", "area", "mean_stain"]


def cell_sheet(spark, d):
    cells = T.cells(spark, d)
    stats = AS.mask_stats(T.mask_pixels(cells))
    n_alleles = T.alleles(spark, d).where("cell >= 0").groupBy("fov", "cell").agg(F.count(F.lit(1)).alias("n_alleles"))
    # counting needs only the role of a spot: its own projection, not the whole sheet
    lay = T.layout(spark, d).select("modality", "hybe", "fiducial_channel")
    role = T.spots(spark, d).select("fov", "cell", "modality", "hybe", "channel").join(checked_broadcast(lay), ["modality", "hybe"], "left").select(
        "fov", "cell", F.when(F.col("fiducial_channel") == F.col("channel"), "fiducial").otherwise("readout").alias("channel_role"))
    return X.cell_rows(cells, stats, X.per_cell_counts(role), n_alleles, T.placements(spark, d), T.FRAME_SHAPE)


@query("cell_rows", CELLS_SQL)
def cell_rows(spark, d):
    s = cell_sheet(spark, d)
    return s.select(*[r(c).alias(c) if c in ("nucleus_um2", "nucleus_centroid_x", "nucleus_centroid_y") else F.col(c) for c in CELL_EXPORT])


@query("home_transform", """
SELECT fov, cell, round(c_xt, 6) AS home_yx_dx, round(c_yt, 6) AS home_yx_dy, CAST(0 AS DOUBLE) AS home_yx_theta_deg, CAST(1 AS DOUBLE) AS home_yx_scale, dz_cell AS home_dz
FROM m_entries WHERE modality = 'DNA' AND hybe = 'Hyb_001'""")
def home_transform(spark, d):
    """The affine parts of each cell's stored home transform."""
    from chromaloom.functions import affine

    e = T.cell_entries(spark, d).where("modality = 'DNA' and hybe = 'Hyb_001'")
    h = affine.of("h_cell")
    return e.select("fov", "cell", r("h_cell.xt").alias("home_yx_dx"), r("h_cell.yt").alias("home_yx_dy"),
                    h.theta_deg().alias("home_yx_theta_deg"), h.scale().alias("home_yx_scale"), F.col("dz_cell").alias("home_dz"))


@query("allele_rows", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY allele_id, slot ORDER BY cand) - 1 AS k FROM m_candidates)
SELECT 'F' || lpad(CAST(a.fov AS VARCHAR), 3, '0') || '-A' || CAST(a.allele_id AS VARCHAR) AS allele_key, a.allele_id, a.fov, a.cell,
       CASE WHEN a.cell < 0 THEN '' ELSE 'F' || lpad(CAST(a.fov AS VARCHAR), 3, '0') || '-C' || CAST(a.cell AS VARCHAR) END AS cell_key, coalesce(c.celltype, '') AS celltype,
       CAST(s.slot AS INTEGER) AS bin_index, coalesce(k.k, -1) AS candidate_index, coalesce(p.n_cand, 0) AS n_candidates,
       coalesce(abs(k.y - p.y_um / 0.208) <= 0.01 AND abs(k.x - p.x_um / 0.208) <= 0.01 AND abs(k.z - p.z_um / 0.2) <= 0.01, FALSE) AS is_selected,
       k.x AS readout_adj_x, k.y AS readout_adj_y, k.z AS readout_adj_z, k.amplitude AS readout_adj_amplitude, k.quality AS readout_quality,
       round(p.x_um, 6) AS final_x_um, round(p.y_um, 6) AS final_y_um, round(p.z_um, 6) AS final_z_um
FROM m_alleles a CROSS JOIN (SELECT unnest(range(9)) AS slot) s LEFT JOIN m_cells c ON c.fov = a.fov AND c.cell = a.cell
LEFT JOIN m_polymer p ON p.allele_id = a.allele_id AND p.slot = s.slot LEFT JOIN k ON k.allele_id = a.allele_id AND k.slot = s.slot""")
def allele_rows(spark, d):
    """Nine declared slots: the trailing two keep their empty row on every allele."""
    found = T.candidates(spark, d).repartition("allele_id")      # dealt once: bins and their collapse stay where they are
    a = X.allele_rows(T.alleles(spark, d), found, polymer.collapse(found), 9, T.cells(spark, d))
    return a.withColumns({c: r(c) for c in ("final_x_um", "final_y_um", "final_z_um")})


@query("combined_compact", f"""
SELECT s.spot_key, s.fov, s.modality, s.hybe, readout_name, readout_id, channel_role, s.cell, s.cell_key, s.celltype, uid, p_exist,
       k.nucleus_um2 AS cell_nucleus_um2, k.n_spots_readout AS cell_n_spots_readout, k.touches_frame_edge AS cell_touches_frame_edge, k.area AS cell_area, k.mean_stain AS cell_mean_stain
FROM ({SPOTS_SQL}) s LEFT JOIN ({CELLS_SQL}) k ON k.cell_key = s.cell_key""")
def combined_compact(spark, d):
    kept = [*X.COMBINED_CELL, "area", "mean_stain"]      # declared cell columns of the compact sheet, then the discovered ones
    out = X.combined_sheet(T.spots(spark, d), T.layout(spark, d), cell_sheet(spark, d), kept)
    out = out.select(*[c for c in out.columns if c in X.COMBINED_SPOT or c.startswith("cell_")])
    return out.drop("adj_x_um", "adj_y_um", "adj_z_um").withColumn("cell_nucleus_um2", r("cell_nucleus_um2"))


@query("combined_full", f"""
SELECT s.*, k.nucleus_px AS cell_nucleus_px, k.n_spots AS cell_n_spots, k.n_alleles AS cell_n_alleles, k."cellcycle_R" AS "cell_cellcycle_R", k.area AS cell_area
FROM ({SPOTS_SQL}) s LEFT JOIN ({CELLS_SQL}) k ON k.cell_key = s.cell_key""")
def combined_full(spark, d):
    out = X.combined_sheet(T.spots(spark, d), T.layout(spark, d), cell_sheet(spark, d), ["nucleus_px", "n_spots", "n_alleles", "cellcycle_R", "area"])
    out = out.drop("adj_x", "adj_y", "adj_z", "adj_x_um", "adj_y_um", "adj_z_um")
    return out.withColumns({c: r(c) for c in UM if c.startswith("raw")})


@query("spot_sheet_adjusted", """
SELECT fov, uid, cell, modality, hybe, round(adj_y * CAST(0.208 AS DOUBLE) + 3.3333e-9, 6) AS adj_y_um, round(adj_x * CAST(0.208 AS DOUBLE) + 3.3333e-9, 6) AS adj_x_um, round(adj_z * CAST(0.2 AS DOUBLE), 6) AS adj_z_um FROM m_projected""")
def spot_sheet_adjusted(spark, d):
    """Raw coordinates carried into the shared frame, then scaled once to um."""
    lay = FR.attach_layers(T.spots(spark, d), T.fov_matrices(spark, d), T.bridges(spark, d), T.cell_entries(spark, d), T.anchors(spark, d))
    p = FR.project(lay, "DNA", ["fov", "uid", "cell", "modality", "hybe"])
    um = p.select("fov", "uid", "cell", "modality", "hybe", *X.scaled("adj"))
    return um.select("fov", "uid", "cell", "modality", "hybe", r(F.col("adj_y_um") + 3.3333e-9).alias("adj_y_um"),
                     r(F.col("adj_x_um") + 3.3333e-9).alias("adj_x_um"), r("adj_z_um").alias("adj_z_um"))


# Stored keys are bare in the first fields and (hybe, channel) later; some raw lists lost an entry,
# some alleles carry a stored collapse, some rounds were rejected or lost their fiducial.
SHEET_SQL = """
ax AS (SELECT CAST(i AS INTEGER) AS bin_index, CAST(101 + i AS INTEGER) AS readout_id, CASE WHEN i < 5 THEN 'Hyb_00' || CAST(i + 1 AS VARCHAR) ELSE '' END AS hybe, CASE WHEN i < 5 THEN 488 ELSE 0 END AS channel FROM (SELECT unnest(range(6)) AS i)),
al AS (SELECT *, CASE WHEN allele_id % 3 <> 0 THEN 'DNA' END AS modality FROM m_alleles),
ca AS MATERIALIZED (SELECT fov, allele_id, 'Hyb_00' || CAST(slot + 1 AS VARCHAR) AS hybe, CASE WHEN slot < 5 THEN slot ELSE -1 END AS bin_index, CASE WHEN slot < 5 OR fov >= 12 THEN 488 ELSE 0 END AS channel,
  cand, y, x, z, amplitude, row_number() OVER (PARTITION BY allele_id, slot ORDER BY cand, amplitude) - 1 AS k FROM m_candidates),
nn AS (SELECT allele_id, hybe, count(*) AS n, count(*) FILTER (cand % 7 <> 0) AS n_raw FROM ca GROUP BY 1, 2),
rows AS (SELECT a.allele_id, ax.bin_index, ax.hybe, ax.channel, ax.readout_id, 'H' AS datatype FROM al a CROSS JOIN ax
  UNION ALL SELECT DISTINCT allele_id, -1, hybe, channel, NULL, NULL FROM ca WHERE bin_index < 0),
fin AS (SELECT allele_id, ax.bin_index, CAST(ax.bin_index AS DOUBLE) AS y, CAST(allele_id % 100 AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS z FROM al CROSS JOIN ax WHERE allele_id % 11 = 0
  UNION ALL SELECT allele_id, bin_index, y, x, z FROM (SELECT *, row_number() OVER (PARTITION BY allele_id, bin_index ORDER BY amplitude DESC, k) AS rn FROM ca WHERE bin_index >= 0) WHERE rn = 1 AND allele_id % 11 <> 0),
lay AS (SELECT hybe, readout_id, datatype, readout_name FROM m_layout WHERE modality = 'DNA')"""


def stored_alleles(spark, d):
    """(alleles, traces, fiducials, rejections, axis, records) as a traced store would hold them."""
    from pyspark.sql import Window

    # dealt once by allele: numbering, slots, rows and their parts all stay where they are
    a = T.alleles(spark, d)
    place = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(i.cast("double").alias("y"), (F.col("allele_id") % 100).cast("double").alias("x"), F.lit(2.0).alias("z")))
    alleles = a.select("fov", "cell", "allele_id", F.when(F.col("allele_id") % 3 != 0, "DNA").alias("modality"), F.when(F.col("allele_id") % 11 == 0, place).alias("final_polymer"),
                       F.col("allele_id").alias("anchor_uid"))
    w = Window.partitionBy("fov", "allele_id", "slot").orderBy("cand", "amplitude")
    c = T.candidates(spark, d).repartition("fov", "allele_id").select("fov", "allele_id", F.concat(F.lit("Hyb_00"), (F.col("slot") + 1).cast("string")).alias("hybe"), F.when(F.col("fov") >= 12, 488).alias("channel"),
                                      (F.row_number().over(w) - 1).alias("k"), "cand", "y", "x", "z", "amplitude", "quality")
    values = ["k", "y", "x", "z", "amplitude", "quality"]
    keys = ["fov", "allele_id", "hybe", "channel"]
    both = F.array(F.struct(F.lit("adj").alias("side"), F.col("y")), F.struct(F.lit("raw").alias("side"), (F.col("y") + 1).alias("y")))
    sides = c.select(*keys, "cand", "k", F.explode(both).alias("s"), *values[2:]).where("s.side = 'adj' or cand % 7 <> 0")
    traces = sides.select(*keys, "s.side", "k", "s.y", *values[2:])
    fiducials = c.where("hybe in ('Hyb_001', 'Hyb_002', 'Hyb_006')").groupBy(*keys).agg(F.min("y").alias("y")).select(
        *keys, F.when(F.col("allele_id") % 5 != 0, F.col("y")).alias("fiducial_adj_y"))
    rejections = a.where("allele_id % 13 = 0").repartition("fov", "allele_id").select("fov", "allele_id", F.lit("Hyb_003").alias("hybe"), F.lit(None).cast("int").alias("channel"), F.lit("no peak").alias("rejected_reason"))
    axis = spark.createDataFrame([(i, 101 + i, f"Hyb_00{i + 1}" if i < 5 else "", 488 if i < 5 else None) for i in range(6)], "bin_index int, readout_id int, hybe string, channel int")
    return alleles, traces, fiducials, rejections, axis, T.layout(spark, d).where("modality = 'DNA'")


@query("allele_sheet", f"""WITH {SHEET_SQL}
SELECT r.allele_id, r.bin_index, r.hybe, r.channel AS readout_channel, coalesce(r.readout_id, lay.readout_id, -1) AS readout_id, coalesce(r.datatype, lay.datatype, '') AS datatype, coalesce(readout_name, '') AS readout_name,
  CAST(coalesce(ca.k, -1) AS INTEGER) AS candidate_index, coalesce(nn.n, 0) AS n_candidates, CASE WHEN r.allele_id % 11 = 0 THEN 'stored' ELSE 'computed' END AS selection_rule,
  coalesce(abs(ca.x - f.x) <= 0.01 AND abs(ca.y - f.y) <= 0.01 AND abs(ca.z - f.z) <= 0.01, FALSE) AS is_selected, CASE WHEN r.allele_id % 13 = 0 AND r.bin_index = 2 THEN 'no peak' ELSE '' END AS rejected_reason,
  ca.k IS NOT NULL AND r.hybe IN ('Hyb_001', 'Hyb_002', 'Hyb_006') AND r.allele_id % 5 <> 0 AS fiducial_found, ca.x AS readout_adj_x, CASE WHEN n = n_raw THEN ca.y + 1 END AS readout_raw_y, f.x AS final_x,
  coalesce(a.modality, 'RNA') AS modality, CASE WHEN a.modality IS NULL THEN 'assumed' ELSE 'provenance' END AS modality_source, coalesce(c.celltype, '') AS celltype
FROM rows r JOIN al a USING (allele_id) LEFT JOIN m_cells c ON c.fov = a.fov AND c.cell = a.cell LEFT JOIN lay ON lay.hybe = r.hybe
LEFT JOIN ca ON ca.allele_id = r.allele_id AND ca.hybe = r.hybe LEFT JOIN nn ON nn.allele_id = r.allele_id AND nn.hybe = r.hybe LEFT JOIN fin f ON f.allele_id = r.allele_id AND f.bin_index = r.bin_index""")
def allele_sheet(spark, d):
    """The whole sheet: axis of six slots (one never imaged), QC rounds behind the bins."""
    from chromaloom.operators import allele_sheet as S

    out = S.allele_sheet(*stored_alleles(spark, d), T.cells(spark, d), "RNA")
    return out.select("allele_id", "bin_index", "hybe", "readout_channel", "readout_id", "datatype", "readout_name", "candidate_index", "n_candidates", "selection_rule", "is_selected",
                      "rejected_reason", "fiducial_found", "readout_adj_x", "readout_raw_y", "final_x", "modality", "modality_source", "celltype")
