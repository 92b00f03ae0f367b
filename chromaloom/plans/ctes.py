"""SQL definitions of the model tables, used by the reference SQL of the queries."""

CTES = {
    "m_cells": """
SELECT CAST(o_orderkey % 25 AS INTEGER) AS fov, o_orderkey AS cell,
       CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS celltype,
       o_totalprice AS area, CAST(o_custkey % 97 AS DOUBLE) AS mean_stain,
       CAST(o_custkey % 50 AS DOUBLE) / CAST(50 AS DOUBLE) + CAST(0.2 AS DOUBLE) AS solidity,
       CAST(o_custkey % 50 AS INTEGER) AS mask_y0, CAST(floor(o_totalprice / 5000) AS INTEGER) AS mask_x0,
       CAST(o_custkey % 4 + 1 AS INTEGER) AS mask_side
FROM orders""",
    "m_spots": """
SELECT CAST(l_orderkey % 25 AS INTEGER) AS fov,
       l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS uid,
       CASE WHEN l_suppkey % 20 = 0 THEN -1 ELSE l_orderkey END AS cell,
       CASE WHEN l_linestatus = 'F' THEN 'DNA' ELSE 'RNA' END AS modality,
       'Hyb_00' || CAST(l_linenumber AS VARCHAR) AS hybe,
       CASE l_returnflag WHEN 'A' THEN 488 WHEN 'N' THEN 555 ELSE 635 END AS channel,
       l_quantity AS raw_y, l_extendedprice / CAST(1000 AS DOUBLE) AS raw_x, l_tax * CAST(100 AS DOUBLE) AS raw_z,
       l_quantity * CAST(0.208 AS DOUBLE) AS y_um,
       l_extendedprice / CAST(1000 AS DOUBLE) * CAST(0.208 AS DOUBLE) AS x_um,
       l_tax * CAST(100 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS z_um,
       CASE WHEN l_quantity <> 50 THEN l_extendedprice END AS brightness,
       CASE WHEN l_tax <> 0 THEN l_discount * CAST(10 AS DOUBLE) END AS p_exist,
       CASE WHEN l_tax < 0.055 THEN 'accepted' WHEN l_tax < 0.065 THEN 'not_fit' ELSE 'rejected' END AS z_status
FROM lineitem""",
    "m_alleles": """
SELECT CAST(o_orderkey % 25 AS INTEGER) AS fov,
       CASE WHEN o_orderkey % 20 = 7 THEN -1 ELSE o_orderkey END AS cell, o_orderkey * 2 + h AS allele_id
FROM orders, (VALUES (0), (1)) AS hom(h)""",
    "m_candidates": """
SELECT CAST(l_orderkey % 25 AS INTEGER) AS fov,
       CASE WHEN l_orderkey % 20 = 7 THEN -1 ELSE l_orderkey END AS cell,
       l_orderkey * 2 + l_partkey % 2 AS allele_id, l_linenumber - 1 AS slot,
       l_partkey * 1000000000000 + l_suppkey * 1000000 + CAST(l_quantity AS BIGINT) * 10000
       + CAST(round(l_tax * 100) AS BIGINT) * 100 + CAST(round(l_discount * 100) AS BIGINT) AS cand, l_quantity AS y,
       l_extendedprice / CAST(1000 AS DOUBLE) AS x, l_tax * CAST(100 AS DOUBLE) AS z,
       l_extendedprice AS amplitude, l_discount AS quality
FROM lineitem""",
    "m_polymer": """
SELECT fov, cell, allele_id, slot, n_cand, cand, amplitude AS amp, y * CAST(0.208 AS DOUBLE) AS y_um,
       x * CAST(0.208 AS DOUBLE) AS x_um, z * CAST(0.2 AS DOUBLE) AS z_um
FROM (SELECT *, count(*) OVER (PARTITION BY allele_id, slot) AS n_cand,
             row_number() OVER (PARTITION BY allele_id, slot ORDER BY amplitude DESC, cand) AS rn
      FROM m_candidates) WHERE rn = 1""",
    "m_traced": """
SELECT a.*, coalesce(t.n, 0) AS n_traced FROM m_alleles a
LEFT JOIN (SELECT allele_id, count(*) AS n FROM m_polymer GROUP BY 1) t USING (allele_id)""",
    "m_dmaps": """
SELECT a.fov, a.cell, a.allele_id, a.slot AS bin_i, b.slot AS bin_j,
       sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um) + (a.z_um-b.z_um)*(a.z_um-b.z_um)) AS d,
       sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um)) AS d_xy
FROM m_polymer a JOIN m_polymer b ON a.allele_id = b.allele_id AND a.slot < b.slot""",
    "m_slotmed": """
SELECT allele_id, slot, median(d) AS med FROM (
  SELECT allele_id, bin_i AS slot, d FROM m_dmaps UNION ALL SELECT allele_id, bin_j, d FROM m_dmaps
  UNION ALL SELECT allele_id, slot, 0 FROM m_polymer) GROUP BY 1, 2""",
    "m_placed": """
SELECT CAST(o_orderkey % 25 AS INTEGER) AS fov, o_orderkey AS cell,
       CASE WHEN o_custkey % 31 <> 0 THEN o_totalprice % CAST(360 AS DOUBLE) END AS theta_deg,
       CAST(o_custkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS "R",
       CASE WHEN o_custkey % 11 <> 0 THEN CAST(o_custkey % 13 AS DOUBLE) - 6 END AS fit_z,
       CAST(o_custkey % 40 AS DOUBLE) / CAST(20 AS DOUBLE) AS radius,
       CAST(o_custkey % 17 AS DOUBLE) - 8 AS ring_level,
       CAST(o_custkey % 23 AS DOUBLE) / CAST(23 AS DOUBLE) AS ring_tail,
       CAST(floor(o_totalprice / 1000) AS DOUBLE) AS total
FROM orders WHERE o_orderstatus <> 'P'""",
    "m_category": """
SELECT *, CASE WHEN "R" >= 0.2 AND fit_z >= -4 AND total >= 20 THEN
  CASE WHEN theta_deg IS NULL THEN ''
       WHEN (((theta_deg - 300) % 360) + 360) % 360 <= 120 THEN 'G1'
       WHEN (((theta_deg - 60) % 360) + 360) % 360 <= 120 THEN 'S'
       WHEN (((theta_deg - 180) % 360) + 360) % 360 <= 100 THEN 'G2/M' ELSE '' END
  ELSE '' END AS category FROM m_placed""",
    "m_counted": "SELECT * FROM m_spots WHERE (p_exist IS NULL OR p_exist >= 0.5) AND cell >= 0",
    "m_sources": """
SELECT * FROM (VALUES ('DNA', 'Hyb_001', 488), ('RNA', 'Hyb_002', 555), ('RNA', 'Hyb_003', 635), ('DNA', 'Hyb_004', 555))
AS s(modality, hybe, channel)""",
    "m_expr": """
SELECT c.fov, c.cell, c.celltype, s.modality, s.hybe, s.channel, count(p.brightness) AS n_spots,
       median(p.brightness) AS brightness_median, coalesce(sum(p.brightness), 0) AS brightness_total
FROM m_cells c CROSS JOIN m_sources s
LEFT JOIN m_counted p ON p.fov = c.fov AND p.cell = c.cell AND p.modality = s.modality AND p.hybe = s.hybe AND p.channel = s.channel
GROUP BY ALL""",
    "m_denom": """
SELECT fov, cell, modality, count(*) AS mod_n_spots, median(brightness) AS mod_brightness_median,
       coalesce(sum(brightness), 0) AS mod_brightness_total FROM m_counted GROUP BY 1, 2, 3""",
    "m_pairs": """
SELECT a.fov, a.cell, a.uid AS point_a, b.uid AS point_b,
       sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um) + (a.z_um-b.z_um)*(a.z_um-b.z_um)) AS d_um
FROM m_spots a JOIN m_spots b ON a.fov = b.fov AND a.cell = b.cell
WHERE a.cell >= 0 AND a.modality = 'RNA' AND b.modality = 'DNA' AND a.z_status = 'accepted' AND b.z_status = 'accepted'""",
    "m_pixels": """
SELECT fov, cell, CAST(mask_y0 + k // mask_side AS INTEGER) AS y, CAST(mask_x0 + k % mask_side AS INTEGER) AS x
FROM (SELECT fov, cell, mask_y0, mask_x0, mask_side, unnest(range(mask_side * mask_side)) AS k FROM m_cells)""",
    "m_maskstats": """
SELECT fov, cell, count(*) AS px, count(*) * CAST(0.208 * 0.208 AS DOUBLE) AS um2, avg(x) AS centroid_x, avg(y) AS centroid_y,
       min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM m_pixels GROUP BY 1, 2""",
    "m_layout": """
SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN 'DNA' ELSE 'RNA' END AS modality,
       'Hyb_00' || CAST(l_linenumber AS VARCHAR) AS hybe, l_linenumber AS hybe_num,
       CASE WHEN l_linenumber <= 5 THEN 'H' WHEN l_linenumber = 6 THEN 'R' ELSE 'T' END AS datatype,
       CAST(100 + CASE WHEN l_linenumber = 6 THEN 2 ELSE l_linenumber END AS INTEGER) AS readout_id,
       'gene_' || CAST(l_linenumber AS VARCHAR) AS readout_name,
       CASE WHEN l_linestatus = 'F' THEN 488 ELSE 555 END AS fiducial_channel FROM lineitem""",
    "m_within": """
SELECT fov, modality, 'Hyb_00' || CAST(n AS VARCHAR) AS hybe, CAST(1 AS DOUBLE) AS w_yy, n * CAST(0.001 AS DOUBLE) AS w_yx,
       n * CAST(0.5 AS DOUBLE) AS w_yt, n * CAST(-0.001 AS DOUBLE) AS w_xy, CAST(1 AS DOUBLE) AS w_xx, fov * CAST(0.25 AS DOUBLE) AS w_xt
FROM (SELECT DISTINCT CAST(l_orderkey % 25 AS INTEGER) AS fov, CASE WHEN l_linestatus = 'F' THEN 'DNA' ELSE 'RNA' END AS modality,
             l_linenumber AS n FROM lineitem WHERE l_linenumber <> 5)""",
    "m_bridges": """
SELECT fov, 'RNA' AS modality, CAST(1 AS DOUBLE) AS b_yy, CAST(0.002 AS DOUBLE) AS b_yx, CAST(13 + fov AS DOUBLE) AS b_yt,
       CAST(-0.002 AS DOUBLE) AS b_xy, CAST(1 AS DOUBLE) AS b_xx, CAST(-7 AS DOUBLE) AS b_xt, 2 + fov * CAST(0.5 AS DOUBLE) AS dz_bridge
FROM (SELECT DISTINCT CAST(o_orderkey % 25 AS INTEGER) AS fov FROM orders) WHERE fov % 5 <> 0""",
    "m_entries": """
SELECT CAST(cell % 25 AS INTEGER) AS fov, cell, modality, 'Hyb_00' || CAST(n AS VARCHAR) AS hybe,
       q * CAST(0.1 AS DOUBLE) AS c_yt, n * CAST(-0.2 AS DOUBLE) AS c_xt, q - 25 AS dz_cell, n <> 4 AS yx_is_residual
FROM (SELECT l_orderkey AS cell, l_linenumber AS n, CASE WHEN l_linestatus = 'F' THEN 'DNA' ELSE 'RNA' END AS modality,
             max(l_quantity) AS q FROM lineitem WHERE l_quantity >= 20 AND l_linenumber <= 4 GROUP BY 1, 2, 3)""",
    # fov route: bridge after within, written out; anchor A = [[1, .01, .5 fov], [-.01, 1, 3]]
    "m_routes": """
SELECT s.*, CASE WHEN w.hybe IS NULL THEN s.raw_y ELSE w_yy*s.raw_y + w_yx*s.raw_x + w_yt END AS wy,
       CASE WHEN w.hybe IS NULL THEN s.raw_x ELSE w_xy*s.raw_y + w_xx*s.raw_x + w_xt END AS wx,
       w.hybe IS NULL AS no_within, b.fov IS NULL AS no_bridge, b_yy, b_yx, b_yt, b_xy, b_xx, b_xt, dz_bridge,
       e.c_yt, e.c_xt, e.dz_cell, e.yx_is_residual
FROM m_spots s LEFT JOIN m_within w ON w.fov = s.fov AND w.modality = s.modality AND w.hybe = s.hybe
LEFT JOIN m_bridges b ON b.fov = s.fov AND b.modality = s.modality
LEFT JOIN m_entries e ON e.fov = s.fov AND e.cell = s.cell AND e.modality = s.modality AND e.hybe = s.hybe""",
    "m_fovroute": """
SELECT *, CASE WHEN no_bridge THEN wy ELSE b_yy*wy + b_yx*wx + b_yt END AS fy,
       CASE WHEN no_bridge THEN wx ELSE b_xy*wy + b_xx*wx + b_xt END AS fx FROM m_routes""",
    # A . H2 . inv(A): H2 is a pure translation t, so the conjugated move is the linear part of A applied to t
    "m_projected": """
SELECT fov, uid, cell, modality, hybe, channel, raw_y, raw_x, raw_z, y_um, x_um, no_within, no_bridge, yx_is_residual,
       CASE WHEN c_yt IS NULL THEN fy WHEN yx_is_residual THEN fy + c_yt + CAST(0.01 AS DOUBLE)*c_xt
            ELSE (raw_y + c_yt) + CAST(0.01 AS DOUBLE)*(raw_x + c_xt) + CAST(0.5 AS DOUBLE)*fov END AS adj_y,
       CASE WHEN c_yt IS NULL THEN fx WHEN yx_is_residual THEN fx - CAST(0.01 AS DOUBLE)*c_yt + c_xt
            ELSE CAST(-0.01 AS DOUBLE)*(raw_y + c_yt) + (raw_x + c_xt) + 3 END AS adj_x,
       raw_z + coalesce(dz_cell, 0) + coalesce(dz_bridge, 0) AS adj_z FROM m_fovroute""",
    "m_verdicts": """
SELECT 'rev' || CAST(user_id % 5 AS VARCHAR) AS reviewer, event_type || '_' || CAST(user_id % 40 AS VARCHAR) AS key,
       CAST(event_id % 20 AS INTEGER) AS page, date_trunc('second', ts) AS stamp, CAST(user_id % 3 AS INTEGER) AS file_no,
       event_id AS line_no, value FROM events""",
    "m_latest": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY reviewer, key, page ORDER BY stamp DESC, file_no DESC, line_no DESC) AS rn
FROM m_verdicts) WHERE rn = 1""",
    "m_shown": """
SELECT reviewer, key, page, CAST(page * 10 + k AS DOUBLE) AS y, CAST(k * 3 AS DOUBLE) AS x, CAST(page AS DOUBLE) AS z,
       least(CAST((line_no + k) % 4 AS INTEGER) - 1, 1) AS keep,
       CASE WHEN line_no % 50 = 0 THEN 2.0 ELSE 1.0 END AS feat, round((value + k) % CAST(1 AS DOUBLE), 4) AS p
FROM m_latest, (VALUES (0), (1), (2)) AS kk(k)""",
    "m_votes": """
SELECT key, CAST(round_even(y / 0.5, 0) AS BIGINT) AS gy, CAST(round_even(x / 0.5, 0) AS BIGINT) AS gx, CAST(round_even(z / 0.5, 0) AS BIGINT) AS gz,
       max(y) AS y, max(x) AS x, max(z) AS z, CAST(sum(CASE WHEN keep > 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN keep >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS seen, max(feat) - min(feat) AS spread
FROM m_shown GROUP BY 1, 2, 3, 4""",
    "m_labelled": """
SELECT *, CASE WHEN spread > 0.001 THEN 'inconsistent' WHEN seen = 0 THEN 'undetermined' WHEN kept = seen THEN 'positive'
               WHEN kept = 0 THEN 'negative' ELSE 'contested' END AS label FROM m_votes""",
    "m_scored": """
SELECT doc_id, quality AS y, CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(2000 AS DOUBLE)) AS score
FROM labels JOIN documents USING (doc_id)""",
    "m_design": """
SELECT p_partkey AS rid, p_brand AS chrom, p_partkey * 1000 AS s, p_partkey * 1000 + p_size * 100 AS e FROM part""",
    "m_steps": """
SELECT rid, next_rid, CASE WHEN chrom = next_chrom THEN abs(next_mid - mid) END AS separation_kb FROM (
  SELECT rid, chrom, (s + e) / CAST(2000 AS DOUBLE) AS mid, lead(rid) OVER (ORDER BY rid) AS next_rid,
         lead(chrom) OVER (ORDER BY rid) AS next_chrom, lead((s + e) / CAST(2000 AS DOUBLE)) OVER (ORDER BY rid) AS next_mid
  FROM m_design) WHERE next_rid IS NOT NULL""",
    "m_records": """
SELECT p_brand AS panel, p_name AS hybe, p_partkey AS rindex, CAST(488 + p_size % 3 * 100 AS INTEGER) AS channel,
       CASE p_type WHEN 'PROMO' THEN 'R' WHEN 'LARGE' THEN 'T' ELSE 'H' END AS dtype FROM part""",
}
