"""Where results go: sidecars, day-partitioned samples, verified archives, append-only notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as JSON lines, nulls left out."""
    frames.write.mode("append").json(path)


def write_samples(samples: DataFrame, path: str, ts_s: str = "ts") -> None:
    samples.withColumn("day", F.to_date(F.timestamp_seconds(ts_s))).write.mode("append").partitionBy("day").json(path)


def read_recent(spark: SparkSession, path: str, seconds: float, schema: str) -> DataFrame:
    """Samples of the last seconds before the newest; only the partitions of the newest two days are read."""
    rows = spark.read.schema(schema + ", day date").json(path)
    newest = rows.agg(F.max("day")).first()[0]
    recent = rows.filter(F.col("day") >= F.date_sub(F.lit(newest), 1))
    last = recent.agg(F.max("ts")).first()[0]
    return recent.filter(F.col("ts") >= (last or 0) - seconds)


def over_budget(files: DataFrame, budget: int) -> DataFrame:
    """(path, length, day) of the oldest files beyond the budget when counting from the newest; one row a file."""
    w = Window.orderBy(F.desc("day"), "path").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("_s", F.sum("length").over(w)).filter(F.col("_s") > budget).drop("_s")


def within_budget(spark: SparkSession, path: str, budget: int) -> list[str]:
    """Delete the oldest days of a day-partitioned store beyond the budget, never the newest one. Returns the days that went."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").withColumn("day", F.regexp_extract("path", r"day=([0-9-]+)", 1)).filter(F.col("day") != "")
    days = files.groupBy("day").agg(F.sum("length").alias("length"))
    kept = F.sum("length").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))
    gone = [r["day"] for r in days.withColumn("_s", kept).filter(F.col("_s") > budget).orderBy("day").collect()]  # one row a day
    newest = days.agg(F.max("day")).first()[0]
    for day in gone:
        if day != newest:
            _delete(spark, f"{path}/day={day}")
    return [d for d in gone if d != newest]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def archive_and_delete(rows: DataFrame, path: str, version: int, original: str) -> int:
    """Archive a version and, only once it reads back whole, delete what it was made from."""
    n = archive(rows, path, version)
    _delete(rows.sparkSession, original)
    return n


def freeze(samples: DataFrame, verdict: DataFrame, path: str, ts: str, seconds: float = 600.0) -> None:
    """A crash capsule: the last seconds of samples and the verdict's rows, as JSON lines of one kind each."""
    last = samples.agg(F.max(ts).alias("_end"))
    tail = samples.crossJoin(F.broadcast(last)).filter(F.col(ts) >= F.col("_end") - seconds).drop("_end")  # one row
    rows = tail.select(F.lit("sample").alias("kind"), F.to_json(F.struct("*")).alias("body")).unionByName(verdict.select(F.lit("verdict").alias("kind"), F.to_json(F.struct("*")).alias("body")))
    rows.withColumn("frozen_at", F.current_timestamp()).write.mode("append").json(path)


def append_frame_note(spark: SparkSession, path: str, frames: DataFrame, seq: int, message: str) -> None:
    """A note on a frame that exists; raises if there is none of this number."""
    if frames.filter(F.col("sequence") == seq).isEmpty():
        raise ValueError(f"there is no frame {seq}")
    append_note(spark, path, f"frame/{seq}", message)


def archive(rows: DataFrame, path: str, version: int) -> int:
    """Write a numbered version and read it back; raises if a row is missing. Returns the rows written."""
    target = f"{path}/version={version:06d}"
    rows.write.mode("errorifexists").parquet(target)
    n, back = rows.count(), rows.sparkSession.read.parquet(target).count()
    if n != back:
        raise RuntimeError(f"{target} holds {back} of {n} rows")
    return n


def append_note(spark: SparkSession, path: str, key: str, message: str, level: str = "INFO") -> None:
    """One of the observer's own notes, in a table apart from the program's log."""
    spark.createDataFrame([(key, message, level)], "key string, message string, level string").withColumn("noted_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def capsules(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """The newest crash capsules; the limit is the listing's."""
    return spark.read.json(path).orderBy(F.desc("frozen_at")).limit(limit)
