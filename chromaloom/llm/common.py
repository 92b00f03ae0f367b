"""Reading of the text tables and small helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaloom.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def min_labels(edges: DataFrame, cut, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: (node, component = smallest node).

    Alternating star contractions: every round replaces the edges of a node by edges to
    its smallest neighbour, so a chain of n nodes needs O(log n) rounds. All steps are
    grouped minima (combined before the shuffle) and joins; nothing is gathered per node.
    Only nodes that occur in an edge are returned; an empty edge table gives no row.
    """
    def smallest(pairs: DataFrame, of: str, to: str) -> DataFrame:
        return pairs.groupBy(F.col(of).alias("u")).agg(F.min(to).alias("m"))

    e = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct()
    e, before = cut(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = smallest(both, "x", "y").select("u", F.least("u", "m").alias("m"))
        # larger neighbours of u point to the smallest node around u
        large = both.where("y > x").join(low, F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        # u and its smaller neighbours point to the smallest of them
        down = smallest(large, "x", "y")
        small = large.join(down, F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        small = small.unionByName(down.select(F.col("u").alias("x"), F.col("m").alias("y"))).where("x <> y").distinct()
        e = cut(small)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
        e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())


def running_offsets(parts: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """Running total of `size` before each row of a short table (one row per file or bucket)."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def ranged_runs(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Positions within `key` in the order of `order` (nulls first), without a window over a key.

    The rows come back dealt into sorted ranges of (key, order) with `part` and `seq`; the runs
    have one row per range and key: `first` (smallest seq), `c` rows, and `before`, the key's
    rows in earlier ranges. A row's position is seq - first + before. At most ranges + keys runs.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranged = cut(rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
                 .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    runs = ranged.groupBy(key, "part").agg(F.min("seq").alias("first"), F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, cut(runs.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))))
