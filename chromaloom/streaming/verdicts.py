"""Reviewer verdicts as a stream: keyed state keeps the latest record per (reviewer, key, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.operators.labels import RECORD, latest_verdicts


def read_events(spark: SparkSession, folder: str, schema, max_files: int = 1, glob: str = "events*.parquet") -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", glob).parquet(folder))


def latest_stream(records: DataFrame) -> DataFrame:
    """Streaming aggregate with the same keep-last rule as the batch operator (update mode)."""
    return latest_verdicts(records)


def submissions_per_window(records: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Watermarked tumbling count of submissions per reviewer."""
    timed = records.withColumn("at", F.col("at").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "reviewer").agg(F.count(F.lit(1)).alias("n"))


def changes(records: DataFrame) -> DataFrame:
    """The records of each micro-batch that became the latest of their (reviewer, key, page).

    The state store holds one record per key, so a batch costs what the batch holds, not what
    the table holds. A late record (older by clock, file, line than the kept one) and a repeated
    one change nothing and are not emitted. The batch's own timestamp, which a restarted batch
    finds again in the log, tells a new winner from an old one.
    """
    rest = [c for c in records.columns if c not in RECORD]
    stamped = records.withColumn("__in", F.current_timestamp())
    # of equal records the one that came first stays
    order = F.struct("at", "file_no", "line_no", -F.unix_micros("__in"))
    latest = stamped.groupBy(*RECORD).agg(F.max_by(F.struct(*rest, "__in"), order).alias("r"))
    return latest.where(F.col("r.__in") == F.current_timestamp()).select(*RECORD, *[f"r.{c}" for c in rest])


def follow(records: DataFrame, root: str, **trigger):
    """Start the stream: a change log under `root`, one folder per batch, and the state beside it.

    A batch that is repeated after a failure writes the same folder again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    return (changes(records).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{root}/state").trigger(**(trigger or {"availableNow": True})).start())


def current(spark: SparkSession, root: str) -> DataFrame:
    """The latest record per (reviewer, key, page): the last change of each."""
    log = spark.read.parquet(f"{root}/changes")
    rest = [c for c in log.columns if c not in (*RECORD, "batch")]
    last = log.groupBy(*RECORD).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*RECORD, *[f"r.{c}" for c in rest])
