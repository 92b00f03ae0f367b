"""Readout map: polymer axis, holes, slot lookup with fallback, probe design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.text import map_entry
from chromaloom.session import checked_broadcast

from .stats import exact_quantiles, ordered_index

NOT_A_BIN = -1


def dense_index(records: DataFrame, panel: str = "panel") -> DataFrame:
    """pindex 0..n-1 of the H rounds of each panel by (rindex, channel, hybe); others get -1."""
    bins = ordered_index(records.where(F.col("dtype") == "H"), ["rindex", "channel", "hybe"], [panel], "pindex")
    rest = records.where(F.col("dtype") != "H").withColumn("pindex", F.lit(NOT_A_BIN).cast("long"))
    return bins.unionByName(rest.select(*bins.columns))


def declared_index(records: DataFrame, lo: int, hi: int) -> DataFrame:
    """pindex = rindex - lo on a declared range; an acquired bin outside it is an error."""
    h = F.col("dtype") == "H"
    outside = h & ((F.col("rindex") < lo) | (F.col("rindex") > hi))
    checked = F.when(outside, F.raise_error(F.concat(F.lit("readout outside the declared range: "), F.col("rindex").cast("string"))).cast("long"))
    return records.withColumn("pindex", F.coalesce(checked, F.when(h, F.col("rindex").cast("long") - lo).otherwise(F.lit(NOT_A_BIN).cast("long"))))


def axis(indexed: DataFrame, n_slots: int, by: list[str]) -> DataFrame:
    """Every slot 0..n-1 of every group, holes included (NULL hybe)."""
    slots = F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long"))
    grid = indexed.select(*by).distinct().select(*by, F.explode(slots).alias("pindex"))
    return grid.join(indexed.where(F.col("pindex") >= 0), [*by, "pindex"], "left")


def check_unique(indexed: DataFrame, by: list[str]) -> DataFrame:
    """Violations of the two uniqueness rules; empty for a valid map."""
    keyed = indexed.groupBy(*by, "hybe", "channel").count().where("count > 1").select(*by, F.lit("key").alias("rule"), "count")
    slot = indexed.where(F.col("pindex") >= 0).groupBy(*by, "pindex").count().where("count > 1").select(*by, F.lit("slot").alias("rule"), "count")
    return keyed.unionByName(slot)


def slot_lookup(stored: DataFrame, slots: DataFrame) -> DataFrame:
    """Stored keys (hybe, channel or NULL) to slots.

    A bare hybe resolves only where the hybe fills exactly one slot; the exact
    (hybe, channel) key always wins.
    """
    lone = checked_broadcast(slots.groupBy("hybe").agg(F.count(F.lit(1)).alias("k"), F.min("slot").alias("lone_slot")).where("k = 1").drop("k"))
    exact = checked_broadcast(slots.select("hybe", "channel", F.col("slot").alias("exact_slot")))
    return stored.join(exact, ["hybe", "channel"], "left").join(lone, "hybe", "left").withColumn(
        "slot", F.coalesce("exact_slot", F.when(F.col("channel").isNull(), F.col("lone_slot")))).drop("exact_slot", "lone_slot")


def map_text(indexed: DataFrame, by: list[str]) -> DataFrame:
    """One text per map; a map is bounded by the rounds of one experiment."""
    entry = map_entry("hybe", "channel", "rindex", "dtype", "pindex")
    return indexed.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("text"))


def design_steps(design: DataFrame) -> DataFrame:
    """(rid, next_rid, separation_kb): consecutive ids; NULL across chromosomes."""
    at = ordered_index(design, ["rid"]).withColumn("mid", (F.col("start") + F.col("end")) / 2000.0)
    nxt = at.select((F.col("idx") - 1).alias("idx"), F.col("rid").alias("next_rid"), F.col("chrom").alias("next_chrom"), F.col("mid").alias("next_mid"))
    gap = F.when(F.col("chrom") == F.col("next_chrom"), F.abs(F.col("next_mid") - F.col("mid")))
    return at.join(nxt, "idx").select("rid", "next_rid", gap.alias("separation_kb"))


def design_step(steps: DataFrame) -> DataFrame:
    """The true median of the non-zero consecutive separations."""
    return exact_quantiles(steps.where("separation_kb > 0"), [], "separation_kb", {"step_kb": 0.5})


def bins_of_keys(parts: list[DataFrame], slots: DataFrame) -> DataFrame:
    """(fov, allele_id, hybe, channel, rindex, dtype, pindex): the bin of every key any part of an allele uses.

    parts(fov, allele_id, hybe, channel or NULL): candidates, fiducials, rejections and so on; slots
    (hybe, channel, rindex, dtype, pindex) is the whole map. A bare hybe has a bin only where it
    has exactly one; a key without a bin is left out, which is not a bin without an identity.
    """
    keys = ["fov", "allele_id", "hybe", "channel"]
    union = parts[0].select(*keys)
    for p in parts[1:]:
        union = union.unionByName(p.select(*keys))
    numbered = slots.select("hybe", "channel", F.struct("rindex", "dtype", "pindex").alias("slot"))
    return slot_lookup(union.distinct(), numbered).where("slot is not null").select(*keys, "slot.*")
