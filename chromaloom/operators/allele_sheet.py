"""The full allele sheet: one row per (allele, slot or QC round, candidate), nothing traced left out.

Stored data sit under a key (hybe, channel); older stores know the hybe only. A slot of the axis
reads its exact key, else the bare hybe where that names one slot; keys no slot reads are QC
rounds and keep rows of their own behind the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.functions.scalar import VOXEL_UM, fov_key
from chromaloom.session import checked_broadcast

from .export import SELECTED_TOL, cell_key
from .readout import slot_lookup

ALLELE = ["fov", "allele_id"]
ROW = [*ALLELE, "bin_index", "row_hybe", "row_channel"]
AXES = ("x", "y", "z")


def placed_keys(stored: DataFrame, axis: DataFrame) -> DataFrame:
    """stored(fov, allele_id, hybe, channel, ...) under the row it belongs to.

    bin_index -1 marks a key no slot reads. Where a slot finds both its exact key and the bare
    hybe, the exact key's rows stay.
    """
    slots = axis.where("hybe <> ''").select("hybe", "channel", F.col("bin_index").alias("slot"))
    # a slot and allele have two keys at most; keys without a slot all stay
    w = Window.partitionBy(*ALLELE, "slot").orderBy(F.col("channel").isNull())
    kept = slot_lookup(stored, slots).withColumn("__r", F.rank().over(w)).where("slot is null or __r = 1").drop("__r")
    named = checked_broadcast(axis.select(F.col("bin_index").alias("slot"), F.col("hybe").alias("__h"), F.coalesce("channel", F.lit(0)).alias("__c")))
    rows = kept.join(named, "slot", "left").withColumns({
        "row_hybe": F.coalesce("__h", "hybe"), "row_channel": F.coalesce("__c", "channel", F.lit(0)), "bin_index": F.coalesce("slot", F.lit(-1)).cast("int")})
    return rows.drop("slot", "hybe", "channel", "__h", "__c")


def candidate_pairs(traces: DataFrame) -> DataFrame:
    """Candidates of every row with their raw side, paired by index where both lists are as long.

    traces(ROW, side, k, y, x, z, amplitude, quality) with side `adj` or `raw`. A wrong pairing
    would be worse than a missing value, so lists of different length leave the raw side blank.
    `best` is the row's brightest candidate (ties: the first).
    """
    at = F.struct("y", "x", "z", "amplitude", "quality")
    sides = [e for s in ("adj", "raw") for e in (F.max(F.when(F.col("side") == s, at)).alias(s), F.count_if(F.col("side") == s).alias(f"n_{s}"))]
    # a row holds the candidates of one slot of one allele
    w = Window.partitionBy(*ROW)
    known = F.when(F.col("adj").isNotNull(), F.struct(F.coalesce("adj.amplitude", F.lit(float("-inf"))), -F.col("k")))
    per = traces.groupBy(*ROW, "k").agg(*sides).select(
        *ROW, "k", "adj", "raw", F.sum("n_adj").over(w).alias("n_candidates"), F.sum("n_raw").over(w).alias("n_raw"), F.max_by("adj", known).over(w).alias("best"))
    raw = F.when(F.col("n_candidates") == F.col("n_raw"), F.col("raw"))
    return per.where("adj is not null").select(*ROW, "k", "n_candidates", "adj", raw.alias("raw"), "best")


def sheet_rows(pairs: DataFrame, fiducials: DataFrame, rejections: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row of every allele of grid(ROW, own): its candidates, or one line without any, beside
    its fiducial and rejection and the allele's `own` values.

    A grid line without a hybe stands for the allele's QC rounds and is no row itself. The parts are
    stacked and told apart inside a row, so parts that are dealt by allele are not dealt again.
    """
    kept = [c for c in fiducials.columns if c.startswith("fiducial_")]
    stacked = pairs
    for part in (fiducials.select(*ROW, F.struct(*kept).alias("fiducial")), rejections.select(*ROW, "rejected_reason"), grid.select(*ROW, "own")):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    w, per_bin = Window.partitionBy(*ROW), Window.partitionBy(*ALLELE, "bin_index")
    told = stacked.select(
        *pairs.columns, F.max("fiducial").over(w).alias("fiducial"), F.max("rejected_reason").over(w).alias("rejected_reason"),
        F.row_number().over(w.orderBy(F.col("k").asc_nulls_last())).alias("__r"), F.first("own", ignorenulls=True).over(per_bin).alias("own"))
    return told.where("own is not null and row_hybe is not null and (k is not null or __r = 1)").drop("__r")


def _um(prefix: str, voxel_um) -> list[Column]:
    return [(F.col(f"{prefix}_{a}") * F.lit(v)).alias(f"{prefix}_{a}_um") for a, v in zip(("y", "x", "z"), voxel_um, strict=True)]


def allele_sheet(alleles: DataFrame, traces: DataFrame, fiducials: DataFrame, rejections: DataFrame, axis: DataFrame, records: DataFrame,
                 cells: DataFrame, modality: str = "", voxel_um=VOXEL_UM) -> DataFrame:
    """The sheet of all alleles.

    alleles(fov, cell, allele_id, modality, final_polymer array<struct<y,x,z>>, anchor_*), axis
    (bin_index, readout_id, hybe, channel; an empty hybe is a slot nothing imaged), records(hybe,
    readout_id, datatype, readout_name), traces as in `candidate_pairs` before their rows are known,
    fiducials(fov, allele_id, hybe, channel, fiducial_*; all NULL: the fit failed) and
    rejections(.., rejected_reason). Every allele has a row for every slot, with candidate_index -1
    and NULL places where nothing was found; QC rounds carry bin_index -1 and their datatype. A
    modality the allele did not record is the caller's and says `assumed`. A place is the stored
    collapse's where that covers the axis (`stored`), else the slot's brightest candidate's
    (`computed`). Tables dealt by (fov, allele_id) are not shuffled again.
    """
    panel = axis.select("bin_index", "readout_id", "hybe", F.coalesce("channel", F.lit(0)).alias("c")).collect()      # tens of rows: one panel
    n_slots = len(panel)
    pairs = candidate_pairs(placed_keys(traces, axis))
    # a stored collapse that covers the whole axis, holes included, is used as it is
    whole = F.coalesce(F.size("final_polymer") >= n_slots, F.lit(False)) & (F.size("final_polymer") > 0)
    anchors = [c for c in alleles.columns if c.startswith("anchor_")]
    own = alleles.where("fov is not null and allele_id is not null").select(
        *ALLELE, "cell", F.col("modality").alias("__m"), F.when(whole, F.col("final_polymer")).alias("__stored"), *anchors)
    # the celltype joins the allele, before it has rows; homeless alleles have none and skip the lookup
    names = cells.select("fov", "cell", "celltype")
    homed = own.where("cell >= 0").join(names, ["fov", "cell"], "left")
    own = homed.unionByName(own.where("cell < 0").withColumn("celltype", F.lit(None).cast("string")))
    # one line per slot, and one for whatever QC rounds the allele has
    bins = F.array(*[F.struct(F.lit(i).alias("bin_index"), F.lit(h).cast("string").alias("row_hybe"), F.lit(c).cast("int").alias("row_channel"))
                     for i, h, c in [*((int(b.bin_index), b.hybe, int(b.c)) for b in panel), (-1, None, None)]])
    whole_own = F.struct(*[c for c in own.columns if c not in ALLELE]).alias("own")
    grid = own.repartition(*ALLELE).select(*ALLELE, whole_own, F.explode(bins).alias("b")).select(*ALLELE, "own", "b.*")
    slot_ids = F.create_map(*[F.lit(v) for b in panel for v in (int(b.bin_index), int(b.readout_id))])
    lay = checked_broadcast(records.select(F.col("hybe").alias("row_hybe"), F.col("readout_id").alias("__own"), "datatype", "readout_name"))
    out = sheet_rows(pairs, placed_keys(fiducials, axis), placed_keys(rejections, axis), grid).select("*", "own.*").drop("own")
    stored = F.get("__stored", F.col("bin_index"))
    final = F.when(F.col("bin_index") >= 0, F.when(F.col("__stored").isNull(), F.col("best")).otherwise(
        F.struct(*[stored[a].alias(a) for a in ("y", "x", "z")], *[F.lit(None).cast("double").alias(a) for a in ("amplitude", "quality")])))
    out = out.join(lay, "row_hybe", "left").withColumn("__rid", F.try_element_at(slot_ids, F.col("bin_index"))).withColumn("__final", final)
    kept = [c for c in fiducials.columns if c.startswith("fiducial_")]
    out = out.select("*", *[F.col(f"__final.{a}").alias(f"final_{a}") for a in AXES], *[F.col(f"fiducial.{c}").alias(c) for c in kept],
                     F.when(F.col("__stored").isNull(), "computed").otherwise("stored").alias("selection_rule"))
    near = None
    for a in AXES:
        close = F.abs(F.col(f"adj.{a}") - F.col(f"final_{a}")) <= SELECTED_TOL
        near = close if near is None else near & close
    sides = [F.col(f"{s}.{a}").alias(f"readout_{s}_{a}") for s in ("adj", "raw") for a in (*AXES, "amplitude")]
    fitted = F.col("fiducial_adj_y").isNotNull()
    sheet = out.select(
        fov_key("fov", "A", "allele_id").alias("allele_key"), "allele_id", "fov", "cell", cell_key().alias("cell_key"), F.coalesce("celltype", F.lit("")).alias("celltype"),
        F.coalesce(F.nullif("__m", F.lit("")), F.lit(modality)).alias("modality"), F.when(F.coalesce("__m", F.lit("")) != "", "provenance").otherwise("assumed").alias("modality_source"),
        "bin_index", F.coalesce("__rid", "__own", F.lit(-1)).alias("readout_id"), F.col("row_hybe").alias("hybe"), F.col("row_channel").alias("readout_channel"),
        F.coalesce("readout_name", F.lit("")).alias("readout_name"), F.when(F.col("bin_index") >= 0, "H").otherwise(F.coalesce("datatype", F.lit(""))).alias("datatype"),
        F.coalesce("k", F.lit(-1)).alias("candidate_index"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "selection_rule",
        F.coalesce(near, F.lit(False)).alias("is_selected"), F.coalesce("rejected_reason", F.lit("")).alias("rejected_reason"), fitted.alias("fiducial_found"),
        *sides, F.col("adj.quality").alias("readout_quality"), "final_x", "final_y", "final_z", *kept, *anchors)
    return sheet.select("*", *_um("final", voxel_um), *_um("readout_adj", voxel_um))
