"""Queries that bundle others: the merged timeline, an error's moment, digest and session report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import errors, health, temporal


def combined_timeline(frames: DataFrame, logs: DataFrame, bookmarks: DataFrame, start_ms: float | None = None, end_ms: float | None = None, limit: int = 200) -> DataFrame:
    """The latest of all three as (ts_ms, kind, line), at most 1000, lines cut to 160 characters; each input has ts_ms and line."""
    both = None
    for kind, rows in (("frame", frames), ("log", logs), ("bookmark", bookmarks)):
        one = rows.select("ts_ms", F.lit(kind).alias("kind"), F.substring("line", 1, 160).alias("line"))
        both = one if both is None else both.unionByName(one)
    if start_ms is not None:
        both = both.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        both = both.filter(F.col("ts_ms") <= end_ms)
    latest = both.orderBy(F.desc("ts_ms"), "kind", "line").limit(min(limit, 1000))
    return latest.orderBy("ts_ms", "kind", "line")


def error_moment(errors_: DataFrame, frames: DataFrame, logs: DataFrame, states: DataFrame, by: list[str], window_ms: int = 6000) -> DataFrame:
    """Each error (id, ts_ms) with its nearest frame, the state in force and the number of log rows and errors within window_ms either side."""
    framed = temporal.nearest(errors_, frames, by).withColumnRenamed("state", "frame")
    stated = temporal.as_of(framed, states, by)
    near = temporal.interval_join(errors_.select(*by, "id", "ts_ms"), logs, window_ms, window_ms, by)
    counts = near.groupBy("id").agg(F.count("*").alias("rows_near"), F.count_if(F.col("r_level") == "ERROR").alias("errors_near"))
    return stated.join(counts, "id", "left").fillna(0, ["rows_near", "errors_near"])


def digest(events: DataFrame, message: str, now_ms: float) -> DataFrame:
    """One row: events, errors, distinct fingerprints, the most frequent one, and the age of the last event."""
    failed = events.filter(F.col("level").isin("ERROR", "FATAL"))
    top = errors.histogram(failed, message, "ts_ms", "source").agg(F.count("*").alias("fingerprints"), F.max_by("sample", "n").alias("top_error"), F.max("n").alias("top_count"))
    totals = events.agg(F.count("*").alias("events"), F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"), (F.lit(now_ms) - F.max("ts_ms")).alias("age_ms"))
    return totals.crossJoin(F.broadcast(top))  # one row each


def session_report(events: DataFrame, by: list[str], error: Column, warning: Column) -> DataFrame:
    """Health and the busiest category of each key."""
    score = health.health(events, by, error, warning, F.lit(False))
    per = events.groupBy(*by, "category").agg(F.count("*").alias("_n"))
    busiest = per.groupBy(*by).agg(F.max_by("category", F.struct("_n", "category")).alias("busiest"))
    return score.join(busiest, by)


def alignment(frames: DataFrame, logs: DataFrame, grace_ms: float = 50) -> DataFrame:
    """Whether no log row that a frame (seq, ts_ms) claims (seq, r_ts_ms) is later than its shutter plus the grace."""
    last = logs.groupBy("seq").agg(F.max("r_ts_ms").alias("last_ms"), F.count("*").alias("n"))
    return frames.join(last, "seq", "left").withColumn("aligned", F.coalesce(F.col("last_ms") <= F.col("ts_ms") + grace_ms, F.lit(True)))


def overview(events: DataFrame) -> DataFrame:
    """One row: events, sources, errors, first and last time, and the source with most errors."""
    per = events.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("e"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    worst = F.max_by("source", F.when(F.col("e") > 0, F.struct("e", "source")))
    return per.agg(F.sum("n").alias("events"), F.count("*").alias("sources"), F.sum("e").alias("errors"), F.min("lo").alias("first_ms"), F.max("hi").alias("last_ms"), worst.alias("worst_source"))


def replay(frames: DataFrame, by: list[str], order: list[str], changed: Column, logs: DataFrame, every: int = 5) -> DataFrame:
    """Every nth frame and each one at which something changed, with the number of log rows (by, r_ts_ms) since the frame shown before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    shown = frames.withColumn("_i", F.row_number().over(w)).withColumn("_c", F.coalesce(changed, F.lit(False))).filter(((F.col("_i") - 1) % every == 0) | F.col("_c"))
    shown = shown.withColumn("_from", F.lag("ts_ms").over(w)).withColumn("changed_moment", F.col("_c")).drop("_i", "_c")
    # a log row belongs to the first frame shown at or after it
    marks = shown.select(*by, F.col("ts_ms").alias("s_ts_ms"))
    flipped = logs.select(*by, (-F.col("r_ts_ms")).alias("ts_ms"))
    owner = temporal.as_of(flipped, marks.select(*by, (-F.col("s_ts_ms")).alias("s_ts_ms")), by)
    counts = owner.groupBy(*by, (-F.col("state.s_ts_ms")).alias("ts_ms")).agg(F.count("*").alias("log_rows"))
    return shown.drop("_from").join(counts, [*by, "ts_ms"], "left").fillna(0, ["log_rows"])
