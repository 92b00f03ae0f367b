"""The population and parameters the registered queries share."""

from __future__ import annotations

from chromaloom.operators import cellcycle, expression, polymer
from chromaloom.operators.gate import Population
from chromaloom.session import cut
from chromaloom.sources import tables as T

# Run parameters of the registered queries.
SOURCES = [("DNA", "Hyb_001", 488), ("RNA", "Hyb_002", 555), ("RNA", "Hyb_003", 635), ("DNA", "Hyb_004", 555)]
RNA, DNA = ["RNA", None, None], ["DNA", None, None]
ARCS = [{"name": "G1", "start_deg": 300, "end_deg": 60}, {"name": "S", "start_deg": 60, "end_deg": 180},
        {"name": "G2/M", "start_deg": 180, "end_deg": 280}]
GATES = {"min_R": 0.2, "min_fit_z": -4, "min_total": 20}
SLOT_OF = {h: k for k, h in enumerate(T.HYBES)}


def polymer_of(spark, d):
    return polymer.collapse(T.candidates(spark, d))


def kept_polymer(spark, d):
    """The collapsed positions as a checkpointed table, for plans that read them several times."""
    return cut(polymer_of(spark, d))


def traced_alleles(spark, d):
    return polymer.completeness(T.alleles(spark, d), polymer_of(spark, d))


def categorised(spark, d):
    return cellcycle.assign(T.placements(spark, d), ARCS, GATES)


def population(spark, d, *parts: str) -> Population:
    """Only the named tables are attached; the rest stays absent."""
    pop = Population(cells=T.cells(spark, d).select("fov", "cell", "celltype"), slot_of=SLOT_OF, traced_modality="DNA")
    if "spots" in parts:
        pop.spots = T.spots(spark, d)
    if "polymer" in parts:
        pop.polymer = polymer_of(spark, d)
    if "alleles" in parts:
        pop.polymer = pop.polymer if pop.polymer is not None else polymer_of(spark, d)
        pop.alleles = polymer.completeness(T.alleles(spark, d), pop.polymer)
    if "expression" in parts:
        pop.expression = expression.expression_table(T.cells(spark, d), T.spots(spark, d), SOURCES)
    if "denominators" in parts:
        pop.denominators = expression.modality_denominators(T.spots(spark, d))
    if "cellcycle" in parts:
        pop.cellcycle = categorised(spark, d)
    return pop
