"""Readers and writers of the formats that recordings, series and matrices come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import ranked
from weftline.operators.raster import quantized


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table by its extension (csv, tsv, parquet, json, orc); None if the path doesn't exist."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "tsv", "parquet", "json", "orc"):
        raise ValueError(f"no reader for .{kind}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", inferSchema=schema is None)
    return reader.format(kind).load(path)


def events_per_unit(recordings: DataFrame) -> DataFrame:
    """``(recording_id, unit_id, t_ms)`` of rows with ``times``, an array of second arrays by unit."""
    units = recordings.select("recording_id", F.posexplode("times").alias("unit_id", "seconds"))
    return units.select("recording_id", "unit_id", F.explode("seconds").alias("s")).select("recording_id", "unit_id", quantized(F.col("s")).alias("t_ms"))


def events_pooled(recordings: DataFrame) -> DataFrame:
    """The same of rows with parallel arrays ``times`` (seconds) and ``ids``; ids are renumbered from 0 by recording."""
    from pyspark.sql import Window

    flat = recordings.select("recording_id", F.explode(F.arrays_zip("times", "ids")).alias("e")).select("recording_id", F.col("e.ids").alias("orig_id"), quantized(F.col("e.times")).alias("t_ms"))
    ids = flat.select("recording_id", "orig_id").distinct()
    ids = ids.withColumn("unit_id", F.row_number().over(Window.partitionBy("recording_id").orderBy("orig_id")) - 1)
    return flat.join(ids, ["recording_id", "orig_id"]).select("recording_id", "unit_id", "t_ms")


def duration_ms(events: DataFrame, forced: int | None = None) -> DataFrame:
    return events.groupBy("recording_id").agg((F.lit(forced) if forced is not None else F.max("t_ms")).alias("duration_ms"))


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """``(path, n, line)``: the trimmed lines that aren't blank (and that ``keep`` takes), numbered from 0 in each file.

    Files are read in blocks; a line's number is its place in its block on top of the lines of the blocks before.
    """
    raw = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    kept = raw.where(F.col("line") != "").withColumn("id", F.monotonically_increasing_id())
    kept = kept.where(keep) if keep is not None else kept
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("path", "block").agg(F.count(F.lit(1)).alias("c")).select("path", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("path", "block").orderBy("id")) - 1
    return kept.withColumn("own", own).join(counts, ["path", "block"]).select("path", (F.col("before") + F.col("own")).alias("n"), "line")


def series_columns(spark: SparkSession, path: str) -> DataFrame:
    """``(roi, t, v)`` of a text matrix whose rows are times and columns are series."""
    lines = numbered_lines(spark, path)
    return lines.select("n", F.posexplode(F.split("line", r"\s+")).alias("roi", "x")).select("roi", F.col("n").cast("int").alias("t"), F.col("x").cast("double").alias("v"))


def coupled_map_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, n, x, marker)``: the lines of coupled-map files as arrays; the first line of a file, and lines that begin with two zeros, are markers."""
    x = F.transform(F.split("line", r"\s+"), lambda v: v.cast("double"))
    rows = numbered_lines(spark, path).select("path", "n", x.alias("x"))
    return rows.withColumn("marker", (F.col("n") == 0) | ((F.col("x")[0] == 0) & (F.col("x")[1] == 0)))


def coupled_map_series(spark: SparkSession, path: str) -> DataFrame:
    """``(path, roi, t, v)`` of coupled-map files: markers are left out, as is the first column; times go on over frames."""
    kept = ranked(coupled_map_rows(spark, path).where("NOT marker"), ["path"], [F.col("n")], "place")
    cells = kept.select("path", (F.col("place") - 1).cast("int").alias("t"), F.posexplode(F.slice("x", F.lit(2), F.size("x") - 1)).alias("roi", "v"))
    return cells.select("path", "roi", "t", "v")


def coupled_map_frames(spark: SparkSession, path: str) -> DataFrame:
    """``(path, frame, start, eps)``: the last value of each marker, and the time that its frame's number times the length of the frame before gives."""
    placed = ranked(coupled_map_rows(spark, path).where("marker"), ["path"], [F.col("n")], "place")
    order = Window.partitionBy("path").orderBy("n")  # markers only
    length = F.coalesce(F.col("n") - F.lag("n").over(order) - 1, F.lit(0))
    return placed.select("path", (F.col("place") - 1).cast("int").alias("frame"), ((F.col("place") - 1) * length).cast("long").alias("start"), F.element_at("x", -1).alias("eps"))


def write_any(df: DataFrame, path: str) -> None:
    """A table by its extension (csv, tsv, parquet, json, orc); text kinds have a header, json is one record a line."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        df.write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    elif kind in ("parquet", "json", "orc"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def boundary_text(spark: SparkSession, path: str) -> DataFrame:
    """``(col, dim, rows)`` of an ascii boundary matrix: a dimension and row indices a line, ``#`` comments."""
    kept = numbered_lines(spark, path, ~F.col("line").startswith("#"))
    numbers = kept.select(F.col("n").cast("long").alias("col"), F.split("line", r"\s+").cast("array<long>").alias("n"))
    return numbers.select("col", F.element_at("n", 1).cast("int").alias("dim"), F.slice("n", F.lit(2), F.size("n")).alias("rows"))


def positions(recordings: DataFrame) -> DataFrame:
    """``(recording_id, unit_id, x_um, y_um)`` of rows with ``positions``, an array of pairs by unit or two arrays of coordinates; none if it has another shape."""
    p = F.col("positions")
    turned = (F.size(p) == 2) & (F.size(F.element_at(p, 1)) != 2)
    pairs = F.when(turned, F.arrays_zip(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))).when(F.forall(p, lambda q: F.size(q) == 2), F.transform(p, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    flat = recordings.select("recording_id", F.posexplode(pairs).alias("unit_id", "q"))
    return flat.select("recording_id", "unit_id", F.col("q.x").cast("float").alias("x_um"), F.col("q.y").cast("float").alias("y_um"))


def boundary_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same of int64 files: number of columns, then dimension, length and rows of each."""

    def parse(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                data, at, out = np.frombuffer(content, "<i8"), 1, []
                for col in range(int(data[0])):
                    n = int(data[at + 1])
                    out.append((col, int(data[at]), data[at + 2 : at + 2 + n].tolist()))
                    at += 2 + n
                yield pd.DataFrame(out, columns=["col", "dim", "rows"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "col long, dim int, rows array<long>")


def pairs_text(spark: SparkSession, path: str) -> DataFrame:
    """``(birth, death)`` of a pair file: the number of pairs, then a pair a line."""
    two = F.split("line", r"\s+").cast("array<long>")
    return numbered_lines(spark, path).where("n > 0").select(F.element_at(two, 1).alias("birth"), F.element_at(two, 2).alias("death"))


def write_partitioned(df: DataFrame, path: str, by: list[str], settings: dict | None = None) -> None:
    """Parquet by partition columns; the settings become a JSON manifest beside it with a UTC timestamp."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    if settings is not None:
        import json

        row = df.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string")
        row.select("settings", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written_utc")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_manifest")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, size, modified)`` of files, newest first, by Spark's own file listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")
