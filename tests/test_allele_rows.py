"""The long allele table: every slot of every allele, dealt by allele once."""

import io
from contextlib import redirect_stdout

from chromaloom.operators import export, polymer

CANDIDATES = "fov int, cell long, allele_id long, slot int, cand long, y double, x double, z double, amplitude double, quality double"


def made(spark):
    alleles = spark.createDataFrame([(3, 7, 14), (3, -1, 15), (4, 9, 18)], "fov int, cell long, allele_id long")
    found = spark.createDataFrame([(3, 7, 14, 1, 5, 2.0, 3.0, 4.0, 9.0, .5), (3, 7, 14, 1, 2, 1.0, 1.0, 1.0, 4.0, .1), (3, -1, 15, 0, 8, 6.0, 7.0, 8.0, None, None),
                                   (3, 7, 14, 9, 1, 0.0, 0.0, 0.0, 1.0, .1), (9, 1, 99, 0, 1, 0.0, 0.0, 0.0, 1.0, .1)], CANDIDATES).repartition("allele_id")
    cells = spark.createDataFrame([(3, 7, "WT"), (4, 8, "KO")], "fov int, cell long, celltype string")
    return export.allele_rows(alleles, found, polymer.collapse(found), 3, cells)


def test_every_slot_of_every_allele_and_nothing_else(spark):
    rows = {(r.allele_id, r.bin_index, r.candidate_index): r for r in made(spark).collect()}
    assert sorted(rows) == [(14, 0, -1), (14, 1, 0), (14, 1, 1), (14, 2, -1), (15, 0, 0), (15, 1, -1), (15, 2, -1), (18, 0, -1), (18, 1, -1), (18, 2, -1)]
    first, second = rows[14, 1, 0], rows[14, 1, 1]
    assert (first.readout_adj_y, first.is_selected, second.is_selected, first.n_candidates, first.celltype) == (1.0, False, True, 2, "WT")
    assert first.final_y_um == second.final_y_um and rows[14, 2, -1].n_candidates == 0 and rows[14, 2, -1].final_y_um is None
    assert rows[15, 0, 0].readout_quality is None and rows[15, 0, 0].celltype == "" and rows[18, 0, -1].celltype == "" and rows[18, 0, -1].fov == 4


def test_slots_are_not_shuffled(spark):
    """Exploded slots, bins and their collapse all stay where their allele was dealt to."""
    said = io.StringIO()
    with redirect_stdout(said):
        made(spark).explain()
    dealt = [x for x in said.getvalue().split("\n") if "Exchange hashpartitioning" in x]
    assert dealt and not any("slot" in x for x in dealt) and "Join" in said.getvalue()
