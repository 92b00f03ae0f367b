"""The keyed verdict stream: restarts, late and repeated records, changes only."""

from datetime import datetime, timedelta

from chromaloom.operators.labels import latest_verdicts
from chromaloom.streaming import verdicts as stream

SCHEMA = "reviewer string, key string, page int, at timestamp, file_no int, line_no long, value double"
T0 = datetime(2024, 5, 1)


def record(key, minute, line, value, who="a", page=0, file_no=0):
    return (who, key, page, T0 + timedelta(minutes=minute), file_no, line, float(value))


def run(spark, src, root):
    records = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.follow(records, root)
    q.awaitTermination()
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


def test_state_survives_a_restart_and_emits_changes_only(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    every = []

    def arrive(*rows):
        every.extend(rows)
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def log():
        return sorted((r.batch, r.key, r.value) for r in spark.read.parquet(f"{root}/changes").collect())

    arrive(record("k1", 1, 0, 10), record("k1", 2, 1, 11), record("k2", 1, 2, 20))
    run(spark, src, root)
    assert log() == [(0, "k1", 11.0), (0, "k2", 20.0)]
    # a new process of the same stream: late, repeated, tied by file, and new records
    arrive(record("k1", 0, 3, 99), record("k2", 1, 2, 20), record("k3", 5, 4, 30))
    run(spark, src, root)
    assert log()[2:] == [(1, "k3", 30.0)]
    arrive(record("k2", 1, 0, 21, file_no=1), record("k1", 2, 0, 98))
    run(spark, src, root)
    assert log()[3:] == [(2, "k2", 21.0)]
    want = latest_verdicts(spark.createDataFrame(every, SCHEMA))
    cols = ["reviewer", "key", "page", "at", "file_no", "line_no", "value"]
    assert sorted(map(tuple, stream.current(spark, root).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    # nothing new: no batch, no change
    assert run(spark, src, root) == [] and len(log()) == 4
