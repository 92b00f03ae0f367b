"""Derived tables kept beside the store: expression rows with their input stamps, and speckles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = ["modality", "hybe", "channel"]


def write_expression(rows: DataFrame, stamps: DataFrame, path: str) -> None:
    """Expression rows(fov, cell, source, ...) and the stamps(fov, source, mtime, size) of the files
    they were computed from. The fields present are replaced, the others stay."""
    for name, table in (("rows", rows), ("stamps", stamps)):
        table.repartition("fov").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fov").parquet(f"{path}/{name}")


def read_expression(spark: SparkSession, path: str, fovs: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, stamps); named fields prune to their folders."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("rows", "stamps")]
    return tuple(t if fovs is None else t.where(F.col("fov").isin(fovs)) for t in tables)


def usable_sources(rows: DataFrame, stamps: DataFrame, cells: DataFrame, current: DataFrame) -> DataFrame:
    """(fov, source, covered, same_inputs, usable) for every source of `current`(fov, source, mtime, size).

    An entry is usable only if it holds a row for exactly the cells its field has now, and was
    computed from the files that are there now: a field segmented after it was cached, or a
    re-detected slice, must not be served from the cache. Cell sets are compared by counts of
    one anti-symmetric union, never gathered.
    """
    keys = ["fov", *SOURCE]
    have = rows.select(*keys, "cell").distinct().withColumn("__c", F.lit(1))
    want = current.select(*keys).join(cells.select("fov", "cell").distinct(), "fov", "left").withColumn("__w", F.lit(1))
    both = want.join(have, [*keys, "cell"], "full")
    # a field without cells has one row without a cell
    odd = (F.col("__c").isNull() & F.col("cell").isNotNull()) | F.col("__w").isNull()
    covered = both.groupBy(*keys).agg((F.count_if(odd) == 0).alias("covered"))
    old = stamps.select(*keys, F.col("mtime").alias("__m"), F.col("size").alias("__s"), F.lit(True).alias("__known"))
    out = current.join(covered, keys, "left").join(old, keys, "left")
    same = F.coalesce(F.col("__known") & F.col("mtime").eqNullSafe(F.col("__m")) & F.col("size").eqNullSafe(F.col("__s")), F.lit(False))
    return out.select(*keys, F.coalesce("covered", F.lit(False)).alias("covered"), same.alias("same_inputs"), (F.coalesce("covered", F.lit(False)) & same).alias("usable"))


def cached_or_fresh(rows: DataFrame, usable: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached rows of usable sources, fresh rows of all others (`fresh` is lazy: only those are computed)."""
    keys = ["fov", *SOURCE]
    ok = usable.where("usable").select(*keys)
    stale = usable.where("not usable").select(*keys)
    return rows.join(ok, keys, "left_semi").unionByName(fresh.join(stale, keys, "left_semi"))


def write_speckles(speckles: DataFrame, path: str) -> None:
    speckles.repartition("fov").sortWithinPartitions("fov", "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fov").parquet(path)


def read_speckles(spark: SparkSession, path: str, fov: int | None = None, cells: list[int] | None = None, images: bool = True) -> DataFrame:
    """Speckles of a field, of some of its cells, with or without the image columns.

    The field prunes folders, the cells push down to the (sorted) files, and without images the
    binary columns, which are the bulk of a file, are not read.
    """
    df = spark.read.parquet(path)
    if fov is not None:
        df = df.where(F.col("fov") == fov)
    if cells is not None:
        df = df.where(F.col("cell").isin([int(c) for c in cells]))
    return df if images else df.drop(*[f.name for f in df.schema.fields if f.dataType.typeName() == "binary"])
