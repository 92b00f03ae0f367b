"""Gate algebra: every predicate, clause composition, projections and reports."""

from pyspark.sql import functions as F

from chromaloom.operators.gate import (
    AlleleCount, BarcodePresence, CelltypeIn, CompletenessRange, Condition, CycleCategoryIn, CycleRange,
    ExpressionRange, FovIn, PairDistanceRange, PhaseRange, cell_status, gate_summary)

from .common import DNA, RNA, population
from .registry import query

CELLS_WHERE = "SELECT c.fov, c.cell FROM m_cells c WHERE {}"
PLACED = "SELECT c.fov, c.cell FROM m_cells c JOIN m_category p ON p.cell = c.cell WHERE {}"
COUNT_BY_TYPE = """
SELECT CASE WHEN celltype = '' THEN 'Unassigned' ELSE celltype END AS celltype,
       CAST(sum(CASE WHEN gated THEN 1 ELSE 0 END) AS BIGINT) AS n_gated, count(*) AS n_total FROM ({}) GROUP BY 1"""


def passing(spark, d, condition, *parts):
    return condition.cell_flags(population(spark, d, *parts)).where("gated").select("fov", "cell")


@query("gate_celltype", CELLS_WHERE.format("celltype IN ('1-URGENT', '')"))
def gate_celltype(spark, d):
    return passing(spark, d, Condition([CelltypeIn(["1-URGENT", ""])]))


@query("gate_fov", CELLS_WHERE.format("fov IN (2, 3, 5)"))
def gate_fov(spark, d):
    return passing(spark, d, Condition([FovIn([2, 3, 5])]))


@query("gate_expression_range", """
SELECT c.fov, c.cell FROM m_cells c JOIN m_expr e ON e.cell = c.cell AND e.modality = 'RNA' AND e.hybe = 'Hyb_002' AND e.channel = 555
WHERE e.brightness_median BETWEEN 20000 AND 80000""")
def gate_expression_range(spark, d):
    return passing(spark, d, Condition([ExpressionRange(["RNA", "Hyb_002", 555], "brightness_median", 20000, 80000)]), "expression")


@query("gate_expression_normalised", """
SELECT c.fov, c.cell FROM m_cells c JOIN m_expr e ON e.cell = c.cell AND e.modality = 'RNA' AND e.hybe = 'Hyb_002' AND e.channel = 555
JOIN m_denom n ON n.cell = c.cell AND n.modality = 'RNA' WHERE e.n_spots / nullif(CAST(n.mod_n_spots AS DOUBLE), 0) >= 0.4""")
def gate_expression_normalised(spark, d):
    return passing(spark, d, Condition([ExpressionRange(["RNA", "Hyb_002", 555], "n_spots", lo=0.4, normalize=["by_modality"])]),
                   "expression", "denominators")


@query("gate_phase_wrap", PLACED.format("(((theta_deg - 300) % 360) + 360) % 360 <= 120 AND \"R\" >= 0.5"))
def gate_phase_wrap(spark, d):
    return passing(spark, d, Condition([PhaseRange(300, 60, 0.5)]), "cellcycle")


@query("gate_cycle_range", PLACED.format("fit_z BETWEEN -2 AND 3"))
def gate_cycle_range(spark, d):
    return passing(spark, d, Condition([CycleRange("fit_z", -2, 3)]), "cellcycle")


@query("gate_category", PLACED.format("category IN ('S', '')"))
def gate_category(spark, d):
    return passing(spark, d, Condition([CycleCategoryIn(["S", "Unassigned"])]), "cellcycle")


@query("gate_pair_distance", COUNT_BY_TYPE.format("""
SELECT c.celltype, coalesce(m.d BETWEEN 2 AND 10, FALSE) AS gated FROM m_cells c
LEFT JOIN (SELECT cell, median(d_um) AS d FROM m_pairs GROUP BY 1) m ON m.cell = c.cell"""))
def gate_pair_distance(spark, d):
    return gate_summary(Condition([PairDistanceRange(RNA, DNA, 2.0, 10.0)]).cell_flags(population(spark, d, "spots")))


@query("gate_traced_distance", """
SELECT c.fov, c.cell FROM m_cells c JOIN (
  SELECT s.cell, avg(sqrt((s.y_um-p.y_um)*(s.y_um-p.y_um) + (s.x_um-p.x_um)*(s.x_um-p.x_um))) AS d
  FROM m_spots s JOIN m_polymer p ON p.cell = s.cell AND p.fov = s.fov
  WHERE s.cell >= 0 AND s.modality = 'RNA' AND s.z_status <> 'rejected' AND p.slot = 2 GROUP BY 1) m ON m.cell = c.cell WHERE m.d <= 8""")
def gate_traced_distance(spark, d):
    gate = PairDistanceRange(RNA, ["DNA", "Hyb_003", "traced"], hi=8.0, collapse="mean", dims="xy")
    return passing(spark, d, Condition([gate]), "spots", "polymer")


@query("gate_allele_count", """
SELECT c.fov, c.cell FROM m_cells c LEFT JOIN (SELECT cell, count(*) AS n FROM m_traced WHERE n_traced >= 2 AND cell >= 0 GROUP BY 1) t ON t.cell = c.cell
WHERE coalesce(t.n, 0) BETWEEN 0 AND 1""")
def gate_allele_count(spark, d):
    return passing(spark, d, Condition([AlleleCount(0, 1, 2)]), "alleles")


@query("gate_barcode_presence", """
SELECT fov, cell, allele_id FROM m_traced t WHERE cell >= 0 AND 2 = (SELECT count(*) FROM m_polymer p WHERE p.allele_id = t.allele_id AND p.slot IN (0, 3))""")
def gate_barcode_presence(spark, d):
    flags = Condition([BarcodePresence(["Hyb_001", "Hyb_004"])]).allele_flags(population(spark, d, "alleles"))
    return flags.where("gated").select("fov", "cell", "allele_id")


@query("gate_barcode_absent", """
SELECT c.fov, c.cell FROM m_cells c WHERE c.cell IN (SELECT t.cell FROM m_traced t WHERE t.cell >= 0 AND NOT EXISTS
  (SELECT 1 FROM m_polymer p WHERE p.allele_id = t.allele_id AND p.slot IN (1, 2)))""")
def gate_barcode_absent(spark, d):
    return passing(spark, d, Condition([BarcodePresence(["Hyb_002", "Hyb_003"], absent=True)]), "alleles")


@query("gate_completeness", "SELECT fov, cell, allele_id, n_traced FROM m_traced WHERE cell >= 0 AND n_traced BETWEEN 2 AND 4")
def gate_completeness(spark, d):
    flags = Condition([CompletenessRange(2, 4)]).allele_flags(population(spark, d, "alleles"))
    return flags.where("gated").select("fov", "cell", "allele_id", "n_traced")


MIXED = [[CelltypeIn(["1-URGENT", "2-HIGH"]), PhaseRange(200, 340)], [AlleleCount(2, None, 2), FovIn(list(range(12)))]]
MIXED_SQL = """
SELECT c.fov, c.cell, c.celltype, celltype IN ('1-URGENT', '2-HIGH') AS p0, coalesce((((theta_deg - 200) % 360) + 360) % 360 <= 140, FALSE) AS p1,
       coalesce(t.n, 0) >= 2 AS p2, c.fov < 12 AS p3 FROM m_cells c LEFT JOIN m_category p ON p.cell = c.cell
LEFT JOIN (SELECT cell, count(*) AS n FROM m_traced WHERE n_traced >= 2 AND cell >= 0 GROUP BY 1) t ON t.cell = c.cell"""


@query("gate_or_clauses", f"SELECT fov, cell FROM ({MIXED_SQL}) WHERE (p0 AND p1) OR (p2 AND p3)")
def gate_or_clauses(spark, d):
    return passing(spark, d, Condition(clauses=MIXED), "alleles", "cellcycle")


@query("gate_report", f"""
SELECT 0 AS step, 'celltype_in' AS label, count(*) FILTER (p0) AS n FROM ({MIXED_SQL})
UNION ALL SELECT 1, 'phase_range', count(*) FILTER (p0 AND p1) FROM ({MIXED_SQL})
UNION ALL SELECT 2, '-- OR --', count(*) FILTER (p0 AND p1) FROM ({MIXED_SQL})
UNION ALL SELECT 3, 'allele_count', count(*) FILTER (p2) FROM ({MIXED_SQL})
UNION ALL SELECT 4, 'fov_in', count(*) FILTER (p2 AND p3) FROM ({MIXED_SQL})""")
def gate_report(spark, d):
    return Condition(clauses=MIXED).report(population(spark, d, "alleles", "cellcycle"))


@query("gate_summary", COUNT_BY_TYPE.format(f"SELECT celltype, (p0 AND p1) OR (p2 AND p3) AS gated FROM ({MIXED_SQL})"))
def gate_summary_query(spark, d):
    restored = Condition.from_dict(Condition(clauses=MIXED).to_dict())
    return gate_summary(restored.cell_flags(population(spark, d, "alleles", "cellcycle")))


HET = [[CelltypeIn(["1-URGENT", "3-MEDIUM"]), BarcodePresence(["Hyb_001"])], [CompletenessRange(3, None)]]
HET_SQL = """
SELECT t.fov, t.cell, t.allele_id, t.cell >= 0 AND ((c.celltype IN ('1-URGENT', '3-MEDIUM') AND EXISTS
  (SELECT 1 FROM m_polymer p WHERE p.allele_id = t.allele_id AND p.slot = 0)) OR t.n_traced >= 3) AS gated
FROM m_traced t LEFT JOIN m_cells c ON c.cell = t.cell"""


@query("gate_allele_mask", f"SELECT fov, cell, allele_id FROM ({HET_SQL}) WHERE gated")
def gate_allele_mask(spark, d):
    return Condition(clauses=HET).allele_flags(population(spark, d, "alleles")).where("gated").select("fov", "cell", "allele_id")


@query("cell_status_by_alleles", f"""
SELECT fov, cell, CAST(sum(CASE WHEN gated THEN 1 ELSE 0 END) AS BIGINT) AS n_gated, count(*) AS n_alleles,
       CASE WHEN sum(CASE WHEN gated THEN 1 ELSE 0 END) = 0 THEN 'none' WHEN sum(CASE WHEN gated THEN 1 ELSE 0 END) = count(*) THEN 'all' ELSE 'mixed' END AS status
FROM ({HET_SQL}) WHERE cell >= 0 GROUP BY 1, 2""")
def cell_status_by_alleles(spark, d):
    return cell_status(Condition(clauses=HET).allele_flags(population(spark, d, "alleles")))


@query("alleles_of_gated_cells", """
SELECT a.fov, a.cell, a.allele_id FROM m_alleles a WHERE a.cell >= 0 AND a.cell IN (SELECT cell FROM m_cells WHERE celltype = '2-HIGH')""")
def alleles_of_gated_cells(spark, d):
    pop = population(spark, d, "alleles")
    gated = Condition([CelltypeIn(["2-HIGH"])]).cell_flags(pop).where("gated")
    return pop.alleles.where(F.col("cell") >= 0).join(gated.select("fov", "cell"), ["fov", "cell"], "left_semi").select(
        "fov", "cell", "allele_id")
