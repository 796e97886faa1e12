"""Event and message streams with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.numeric import topic_pattern


def events_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def binned(events: DataFrame, time: str, keys: list[str], width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding event-time windows; rows later than ``delay`` are dropped."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(at.alias("w"), *keys).agg(F.count(F.lit(1)).alias("c")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "c")


def bursts(events: DataFrame, time: str, keys: list[str], gap: str, delay: str, least: int = 3) -> DataFrame:
    """Runs of events with gaps below ``gap`` and at least ``least`` events: onset, end and size."""
    runs = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).select(*keys, F.col("w.start").alias("onset"), F.col("w.end").alias("end"), "n")


def subscribed(messages: DataFrame, topic: str) -> DataFrame:
    """Messages ``(topic, payload)`` whose topic fits the pattern (``+`` one level, ``#`` the rest)."""
    return messages.where(F.col("topic").rlike(topic_pattern(topic)))


def since(messages: DataFrame, key: str, last) -> DataFrame:
    """Messages after an exclusive position."""
    return messages.where(F.col(key) > F.lit(last))


def device_states(changes: DataFrame) -> DataFrame:
    """The merged state of each device after each batch of changes ``(device, key, value)``; a null value deletes the key."""

    def merge(key: tuple, batches, state: GroupState):
        held = dict(zip(*state.get)) if state.exists else {}
        for pdf in batches:
            for k, v in zip(pdf["key"], pdf["value"]):
                if v is None:
                    held.pop(k, None)
                else:
                    held[k] = v
        names = sorted(held)
        state.update((names, [held[k] for k in names]))
        yield pd.DataFrame({"device": [key[0]], "state": [[f"{k}={held[k]}" for k in names]]})

    return changes.groupBy("device").applyInPandasWithState(
        merge, "device string, state array<string>", "names array<string>, vals array<string>", "update", GroupStateTimeout.NoTimeout
    )


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder in local sessions without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return found.rstrip("/")


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Everything there is now, as Parquet files that the executors write, read again.

    In complete mode a batch replaces the one before it, else it is added.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
