import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftline.sources import io
from weftline.streaming import streams


def test_readers(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_csv(tmp_path / "x.tsv", sep="\t", index=False)
    assert io.read_any(spark, str(tmp_path / "x.tsv")).agg(F.sum("a")).first()[0] == 3
    assert io.read_any(spark, str(tmp_path / "none.csv")) is None


def test_recordings(spark):
    unit = spark.createDataFrame([("r", [[0.0015, 1.0], [0.5]])], "recording_id string, times array<array<double>>")
    assert sorted(map(tuple, io.events_per_unit(unit).collect())) == [("r", 0, 2), ("r", 0, 1000), ("r", 1, 500)]
    pooled = spark.createDataFrame([("r", [0.1, 0.2, 0.3], [9, 4, 9])], "recording_id string, times array<double>, ids array<int>")
    assert sorted(map(tuple, io.events_pooled(pooled).collect())) == [("r", 0, 200), ("r", 1, 100), ("r", 1, 300)]


def test_matrices(spark, tmp_path):
    (tmp_path / "m.dat").write_text("# cells\n0\n0\n0\n1 0 1\n1 0 2\n1 1 2\n2 3 4 5\n")
    rows = io.boundary_text(spark, str(tmp_path / "m.dat")).orderBy("col").collect()
    assert [r.dim for r in rows] == [0, 0, 0, 1, 1, 1, 2] and rows[6].rows == [3, 4, 5]
    flat = [7, *(x for r in rows for x in (r.dim, len(r.rows), *r.rows))]
    (tmp_path / "m.bin").write_bytes(np.array(flat, "<i8").tobytes())
    assert io.boundary_binary(spark, str(tmp_path / "m.bin")).orderBy("col").collect() == rows
    (tmp_path / "p.txt").write_text("2\n1 3\n2 4\n")
    assert [tuple(r) for r in io.pairs_text(spark, str(tmp_path / "p.txt")).collect()] == [(1, 3), (2, 4)]


def test_partitioned_writer_and_listing(spark, tmp_path):
    io.write_partitioned(spark.range(4).withColumn("g", F.col("id") % 2), str(tmp_path / "t"), ["g"], {"bin": 10})
    assert spark.read.parquet(str(tmp_path / "t")).where("g = 1").count() == 2
    assert "bin" in spark.read.json(str(tmp_path / "t_manifest")).first().settings
    assert io.files(spark, str(tmp_path / "t"), "*.parquet").count() >= 2


def _stream(spark, path, schema):
    return streams.events_stream(spark, str(path), schema)


def test_late_rows_are_dropped_and_bursts_close(spark, tmp_path):
    ts = ["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:03", "2024-01-01 01:00:00"]
    df = spark.createDataFrame([(t, "u") for t in ts], "s string, u string").select(F.col("s").cast("timestamp").alias("ts"), "u")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = streams.bursts(_stream(spark, tmp_path / "in", "ts timestamp, u string"), "ts", ["u"], "10 seconds", "1 minute")
    rows = streams.run_available(found, "append", str(tmp_path / "c1")).collect()
    assert [(r.u, r.n) for r in rows] == [("u", 3)]
    counted = streams.binned(_stream(spark, tmp_path / "in", "ts timestamp, u string"), "ts", ["u"], "1 minute", "1 minute")
    assert [r.c for r in streams.run_available(counted, "append", str(tmp_path / "c2")).collect()] == [3]


def test_device_state_merges(spark, tmp_path):
    rows = [("d", "a", "1"), ("d", "b", "2"), ("d", "a", None)]
    spark.createDataFrame(rows, "device string, key string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    states = streams.device_states(_stream(spark, tmp_path / "in", "device string, key string, value string"))
    got = streams.run_available(states, "update", str(tmp_path / "c")).collect()
    assert got[-1].state == ["b=2"]


def test_subscription(spark):
    df = spark.createDataFrame([("a/x", 1), ("b/x", 2)], "topic string, n int")
    assert streams.subscribed(df, "a/#").count() == 1 and streams.since(df, "n", 1).count() == 1
