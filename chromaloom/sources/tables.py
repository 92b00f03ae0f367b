"""Model tables (cells, spots, alleles, ...) read from the star-schema test tables.

Each function is a lazy projection of a parquet scan, so filters and column
pruning reach the files. Nothing is materialised here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions import affine
from chromaloom.functions.scalar import VOXEL_UM, nan_to_null

# Fixed values of the mapping from the test tables.
N_FOV = 25
N_SLOTS = 7
CHANNELS = {"A": 488, "N": 555, "R": 635}
HYBES = tuple(f"Hyb_{k:03d}" for k in range(1, N_SLOTS + 1))
DATATYPES = {1: "H", 2: "H", 3: "H", 4: "H", 5: "H", 6: "R", 7: "T"}
FRAME_SHAPE = (64, 128)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark, d) -> DataFrame:
    """One row per segmented cell; the key is always (fov, cell)."""
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % N_FOV).cast("int").alias("fov"),
        F.col("o_orderkey").alias("cell"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_orderpriority")).alias("celltype"),
        F.col("o_totalprice").alias("area"),
        F.pmod(F.col("o_custkey"), F.lit(97)).cast("double").alias("mean_stain"),
        (F.pmod(F.col("o_custkey"), F.lit(50)).cast("double") / 50.0 + 0.2).alias("solidity"),
        F.pmod(F.col("o_custkey"), F.lit(50)).cast("int").alias("mask_y0"),
        F.floor(F.col("o_totalprice") / 5000.0).cast("int").alias("mask_x0"),
        (F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int").alias("mask_side"),
    )


def mask_pixels(cells_df: DataFrame) -> DataFrame:
    """(fov, cell, y, x): the nucleus mask unnested, a square block per cell."""
    side = F.col("mask_side")
    return cells_df.select(
        "fov", "cell", F.col("mask_y0"), F.col("mask_x0"), side,
        F.explode(F.sequence(F.lit(0), side * side - 1)).alias("k"),
    ).select("fov", "cell", (F.col("mask_y0") + F.floor(F.col("k") / side)).cast("int").alias("y"),
             (F.col("mask_x0") + F.pmod(F.col("k"), side)).cast("int").alias("x"))


def spots(spark, d) -> DataFrame:
    """One row per detected spot; cell = -1 means homeless."""
    li = table(spark, d, "lineitem")
    y, x, z = F.col("l_quantity"), F.col("l_extendedprice") / 1000.0, F.col("l_tax") * 100.0
    channel = F.when(F.col("l_returnflag") == "A", 488).when(F.col("l_returnflag") == "N", 555).otherwise(635)
    return li.select(
        (F.col("l_orderkey") % N_FOV).cast("int").alias("fov"),
        (F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("uid"),
        F.when(F.col("l_suppkey") % 20 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_orderkey")).alias("cell"),
        F.when(F.col("l_linestatus") == "F", "DNA").otherwise("RNA").alias("modality"),
        F.concat(F.lit("Hyb_00"), F.col("l_linenumber").cast("string")).alias("hybe"),
        channel.alias("channel"),
        y.alias("raw_y"), x.alias("raw_x"), z.alias("raw_z"),
        (y * VOXEL_UM[0]).alias("y_um"), (x * VOXEL_UM[1]).alias("x_um"), (z * VOXEL_UM[2]).alias("z_um"),
        nan_to_null(F.when(F.col("l_quantity") != 50, F.col("l_extendedprice"))).alias("brightness"),
        F.when(F.col("l_tax") != 0, F.col("l_discount") * 10).alias("p_exist"),
        F.when(F.col("l_tax") < 0.055, "accepted").when(F.col("l_tax") < 0.065, "not_fit")
        .otherwise("rejected").alias("z_status"),
    )


def alleles(spark, d) -> DataFrame:
    """Allele headers: two homologs per cell, traced or not."""
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % N_FOV).cast("int").alias("fov"),
        F.when(F.col("o_orderkey") % 20 == 7, F.lit(-1).cast("long")).otherwise(F.col("o_orderkey")).alias("cell"),
        F.explode(F.array(F.col("o_orderkey") * 2, F.col("o_orderkey") * 2 + 1)).alias("allele_id"),
    )


def candidates(spark, d) -> DataFrame:
    """Traced candidates: several per (allele, slot) are possible."""
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") % N_FOV).cast("int").alias("fov"),
        F.when(F.col("l_orderkey") % 20 == 7, F.lit(-1).cast("long")).otherwise(F.col("l_orderkey")).alias("cell"),
        (F.col("l_orderkey") * 2 + F.pmod(F.col("l_partkey"), F.lit(2))).alias("allele_id"),
        (F.col("l_linenumber") - 1).alias("slot"),
        # a key of the whole row: rows that share it are equal in every column that is read
        (F.col("l_partkey") * 1000000000000 + F.col("l_suppkey") * 1000000 + F.col("l_quantity").cast("long") * 10000
         + F.round(F.col("l_tax") * 100).cast("long") * 100 + F.round(F.col("l_discount") * 100).cast("long")).alias("cand"),
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000.0).alias("x"),
        (F.col("l_tax") * 100.0).alias("z"),
        F.col("l_extendedprice").alias("amplitude"), F.col("l_discount").alias("quality"),
    )


def placements(spark, d) -> DataFrame:
    """Cell-cycle placement capsule; cells of status P were never placed."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    return o.select(
        (F.col("o_orderkey") % N_FOV).cast("int").alias("fov"),
        F.col("o_orderkey").alias("cell"),
        F.when(F.col("o_custkey") % 31 != 0, F.pmod(F.col("o_totalprice"), F.lit(360.0))).alias("theta_deg"),
        (F.pmod(F.col("o_custkey"), F.lit(100)).cast("double") / 100.0).alias("R"),
        F.when(F.col("o_custkey") % 11 != 0, F.pmod(F.col("o_custkey"), F.lit(13)).cast("double") - 6.0).alias("fit_z"),
        (F.pmod(F.col("o_custkey"), F.lit(40)).cast("double") / 20.0).alias("radius"),
        (F.pmod(F.col("o_custkey"), F.lit(17)).cast("double") - 8.0).alias("ring_level"),
        (F.pmod(F.col("o_custkey"), F.lit(23)).cast("double") / 23.0).alias("ring_tail"),
        F.floor(F.col("o_totalprice") / 1000.0).cast("double").alias("total"),
    )


def layout(spark, d) -> DataFrame:
    """Imaging rounds seen in the data, one row per (modality, hybe).

    Grouped from the spots with map-side combine; at most one row per round.
    """
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return li.groupBy(
        F.when(F.col("l_linestatus") == "F", "DNA").otherwise("RNA").alias("modality"),
        n.alias("hybe_num"),
    ).agg(F.count(F.lit(1)).alias("n_rows")).select(
        "modality", F.concat(F.lit("Hyb_00"), F.col("hybe_num").cast("string")).alias("hybe"), "hybe_num",
        F.when(F.col("hybe_num") <= 5, "H").when(F.col("hybe_num") == 6, "R").otherwise("T").alias("datatype"),
        (F.lit(100) + F.when(F.col("hybe_num") == 6, 2).otherwise(F.col("hybe_num"))).cast("int").alias("readout_id"),
        F.concat(F.lit("gene_"), F.col("hybe_num").cast("string")).alias("readout_name"),
        F.when(F.col("modality") == "DNA", 488).otherwise(555).alias("fiducial_channel"),
    )


def fov_matrices(spark, d) -> DataFrame:
    """Same-modality FOV layer: (fov, modality, hybe) -> affine; Hyb_005 was never fitted."""
    li = table(spark, d, "lineitem").where(F.col("l_linenumber") != 5)
    keys = li.groupBy((F.col("l_orderkey") % N_FOV).cast("int").alias("fov"),
                      F.when(F.col("l_linestatus") == "F", "DNA").otherwise("RNA").alias("modality"),
                      F.col("l_linenumber").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return keys.select("fov", "modality", F.concat(F.lit("Hyb_00"), F.col("n").cast("string")).alias("hybe"),
                       affine.make(yy=F.lit(1.0), yx=F.col("n") * 0.001, yt=F.col("n") * 0.5,
                                   xy=F.col("n") * -0.001, xx=F.lit(1.0), xt=F.col("fov") * 0.25).alias("h_within"))


def bridges(spark, d) -> DataFrame:
    """Cross-modal FOV layer RNA -> shared (DNA); every fifth FOV has none yet."""
    o = table(spark, d, "orders")
    fovs = o.groupBy((F.col("o_orderkey") % N_FOV).cast("int").alias("fov")).agg(F.count(F.lit(1)).alias("c"))
    return fovs.where(F.col("fov") % 5 != 0).select(
        "fov", F.lit("RNA").alias("modality"),
        affine.make(yy=F.lit(1.0), yx=F.lit(0.002), yt=F.lit(13.0) + F.col("fov"),
                    xy=F.lit(-0.002), xx=F.lit(1.0), xt=F.lit(-7.0)).alias("h_bridge"),
        (F.lit(2.0) + F.col("fov") * 0.5).alias("dz_bridge"))


def cell_entries(spark, d) -> DataFrame:
    """Per-cell residual entries (fov, cell, modality, hybe) with their anchors."""
    li = table(spark, d, "lineitem").where((F.col("l_quantity") >= 20) & (F.col("l_linenumber") <= 4))
    keys = li.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("n"),
                      F.when(F.col("l_linestatus") == "F", "DNA").otherwise("RNA").alias("modality")
                      ).agg(F.max("l_quantity").alias("q"))
    return keys.select(
        (F.col("cell") % N_FOV).cast("int").alias("fov"), "cell", "modality",
        F.concat(F.lit("Hyb_00"), F.col("n").cast("string")).alias("hybe"),
        affine.make(yy=F.lit(1.0), yx=F.lit(0.0), yt=F.col("q") * 0.1,
                    xy=F.lit(0.0), xx=F.lit(1.0), xt=F.col("n") * -0.2).alias("h_cell"),
        (F.col("q") - 25.0).alias("dz_cell"), (F.col("n") != 4).alias("yx_is_residual"))


def anchors(spark, d) -> DataFrame:
    """Each modality's cell-alignment anchor into the shared frame, per FOV."""
    o = table(spark, d, "orders")
    fovs = o.groupBy((F.col("o_orderkey") % N_FOV).cast("int").alias("fov")).agg(F.count(F.lit(1)).alias("c"))
    return fovs.select("fov", F.explode(F.array(F.lit("DNA"), F.lit("RNA"))).alias("modality")).select(
        "fov", "modality",
        affine.make(yy=F.lit(1.0), yx=F.lit(0.01), yt=F.col("fov") * 0.5,
                    xy=F.lit(-0.01), xx=F.lit(1.0), xt=F.lit(3.0)).alias("h_anchor"))


def verdicts(spark, d) -> DataFrame:
    """Reviewer log: one record per (reviewer, key, page) submission, newest not yet resolved."""
    return verdict_columns(table(spark, d, "events"))


def verdict_columns(events: DataFrame) -> DataFrame:
    """The same projection for a batch or a stream of submissions."""
    return events.select(
        F.concat(F.lit("rev"), (F.col("user_id") % 5).cast("string")).alias("reviewer"),
        F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 40).cast("string")).alias("key"),
        (F.col("event_id") % 20).cast("int").alias("page"),
        F.date_trunc("second", F.col("ts")).alias("at"), (F.col("user_id") % 3).cast("int").alias("file_no"),
        F.col("event_id").alias("line_no"), F.col("value"),
    )


def shown(records: DataFrame) -> DataFrame:
    """The candidates a record showed, unnested: keep in {1, 0, -1 = abstain}."""
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    return records.select("*", k).select(
        "reviewer", "key", "page", (F.col("page") * 10 + F.col("k")).cast("double").alias("y"),
        (F.col("k") * 3).cast("double").alias("x"), F.col("page").cast("double").alias("z"),
        F.least(F.pmod(F.col("line_no") + F.col("k"), F.lit(4)).cast("int") - 1, F.lit(1)).alias("keep"),
        F.when(F.pmod(F.col("line_no"), F.lit(50)) == 0, F.lit(2.0)).otherwise(F.lit(1.0)).alias("feat"),
        F.round(F.pmod(F.col("value") + F.col("k"), F.lit(1.0)), 4).alias("p"))


def scored_labels(spark, d) -> DataFrame:
    """(y, score): reviewer label and a classifier-like score in (0, 1)."""
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents")
    n = F.col("n_chars").cast("double")
    return lab.join(doc.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (n / (n + 2000.0)).alias("score"))


def probe_design(spark, d) -> DataFrame:
    """readout id -> (chrom, start, end)."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("rid"), F.col("p_brand").alias("chrom"),
                    (F.col("p_partkey") * 1000).alias("start"),
                    (F.col("p_partkey") * 1000 + F.col("p_size") * 100).alias("end"))


def readout_records(spark, d) -> DataFrame:
    """A wide readout panel: one acquired round per part, per brand as the panel name."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_brand").alias("panel"), F.col("p_name").alias("hybe"), F.col("p_partkey").alias("rindex"),
        (F.lit(488) + F.pmod(F.col("p_size"), F.lit(3)) * 100).cast("int").alias("channel"),
        F.when(F.col("p_type") == "PROMO", "R").when(F.col("p_type") == "LARGE", "T").otherwise("H").alias("dtype"))
