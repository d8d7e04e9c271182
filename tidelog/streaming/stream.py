"""The continuous forms on Structured Streaming. Checkpoints hold the offsets, so a restart resumes where it stopped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import levels, timeparse
from ..operators import parsing
from ..operators import signals as batch_signals

#: State of the processors lives in RocksDB; streams that use them need this setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files' lines with their path."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("log_path"))


def console_events(lines: DataFrame, channel: str, line: str = "line", arrived: str = "arrived") -> DataFrame:
    """A console's lines as events for a JSON sink: the time is that of arrival, the line's own is kept as emit_ts_ms, stderr starts as an error."""
    c = F.col(line)
    level = F.coalesce(F.nullif(levels.canonical_level(F.regexp_extract(c, r"(?i)\b(trace|debug|info|warn(?:ing)?|error|fatal|critical)\b", 1)), F.lit("")), F.lit("ERROR" if channel == "stderr" else "INFO"))
    return lines.select(F.col(arrived).alias("ts"), level.alias("level"), levels.level_category(level).alias("category"), F.lit(channel).alias("source"), c.alias("message"), timeparse.parse_timestamp(c).alias("emit_ts_ms"))


def console_tee(lines: DataFrame, sink: str, locks: str, checkpoint: str, **options):
    """Start a query that writes console lines (channel, line, arrived) as events to a JSON sink; each channel is read in the format in which its first recognised lines are.

    The first batch of a channel that a named format reads locks it: the lock (channel, adapter) is kept in a JSON table at `locks`, and later batches and
    sessions are read in that format whatever they look like. Lines before are read by their structure. The event's time is that of arrival, the line's own is
    emit_ts_ms, and stderr starts as an error. One row a channel comes to the driver.
    """

    def tee(frame: DataFrame, epoch: int) -> None:
        spark = frame.sparkSession
        rows = frame.withColumn("_at", F.monotonically_increasing_id()).persist()
        known = known_locks(spark, locks)
        fresh = parsing.detect(rows.join(known, "channel", "left_anti"), "channel", "line", ["_at"]).filter(~F.col("adapter").isin(parsing.FALLBACK))
        new = [(r["source"], r["adapter"]) for r in fresh.collect()]
        if new:
            spark.createDataFrame(new, "channel string, adapter string").coalesce(1).write.mode("append").json(locks)
        held = known.unionByName(spark.createDataFrame(new, known.schema)).select(F.col("channel").alias("source"), "adapter")
        parsed = parsing.parse(rows.select("channel", F.col("line"), F.col("arrived")), held, "channel", "line", **options)
        level = F.when((F.col("channel") == "stderr") & F.col("level").isin(levels.WEAK_LEVELS) & F.col("level_escalated_from").isNull(), "ERROR").otherwise(F.col("level"))
        out = parsed.select(F.col("arrived").alias("ts"), level.alias("level"), levels.level_category(level).alias("category"), F.col("channel").alias("source"), F.coalesce(F.nullif("message", F.lit("")), "line").alias("message"), "data", "adapter", F.col("ts_ms").alias("emit_ts_ms"))
        # a batch that is run again after a failure replaces what it wrote
        out.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(sink)
        rows.unpersist()

    return lines.writeStream.foreachBatch(tee).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_locks(spark: SparkSession, path: str) -> DataFrame:
    """(channel, adapter) of the channels whose format is locked; the first lock of a channel holds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "channel string, adapter string"
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).groupBy("channel").agg(F.min("adapter").alias("adapter"))


def read_parquet(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp under a watermark; a time without zone counts as UTC in a UTC session."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, ts: str = "ts") -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def gap_sessions(events: DataFrame, key: str, gap: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Alerts of a kind that follow within the gap are one, with their count."""
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def watch_hits(events: DataFrame, watches: list[dict]) -> DataFrame:
    return batch_signals.watch_hits(events, watches)


def live_alerts(samples: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Samples above any column's limit, with what it is."""
    kinds = F.filter(F.array(*[F.when(F.col(c) >= x, F.lit(c)) for c, x in limits.items()]), lambda k: k.isNotNull())
    return samples.withColumn("kind", F.explode(kinds))


def around_triggers(triggers: DataFrame, events: DataFrame, before: str = "60 seconds", after: str = "5 seconds") -> DataFrame:
    """The flight recorder: events (ts, key) from before to after a trigger (t_ts, t_key), a stream-stream join whose state the watermarks bound."""
    return triggers.join(events, F.expr(f"t_key = key AND ts >= t_ts - interval {before} AND ts <= t_ts + interval {after}"))


def in_order(frames, *by: str) -> list:
    """A key's rows of one micro-batch in order of time and `by`, whatever Arrow batches they came in."""
    return list(pd.concat(list(frames)).sort_values(["ts_ms", *by], kind="stable").itertuples())


class _Suppressor(StatefulProcessor):
    """Per session: a fingerprint surfaces first and then only at a higher tier."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "fp string", "tier int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in in_order(rows):
            fp = (r.fp,)
            last = self.seen.getValue(fp)[0] if self.seen.containsKey(fp) else 0
            if r.tier > last:
                self.seen.updateValue(fp, (int(r.tier),))
                out.append((key[0], r.fp, int(r.tier), float(r.ts_ms)))
        yield pd.DataFrame(out, columns=["session", "fp", "tier", "ts_ms"])

    def close(self) -> None:
        pass


class _Limiter(StatefulProcessor):
    """Per session and tier: at least the tier's gap between two signals."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", "tier int", "ts_ms double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        gaps = {rank: batch_signals.GAPS_S[name] * 1000.0 for name, rank in batch_signals.TIERS.items()}
        out = []
        for r in in_order(rows):
            tier = (int(r.tier),)
            last = self.last.getValue(tier)[0] if self.last.containsKey(tier) else None
            if last is None or r.ts_ms - last >= gaps.get(int(r.tier), 0.0):
                self.last.updateValue(tier, (float(r.ts_ms),))
                out.append((key[0], r.fp, int(r.tier), float(r.ts_ms)))
        yield pd.DataFrame(out, columns=["session", "fp", "tier", "ts_ms"])

    def close(self) -> None:
        pass


_SIGNAL = "session string, fp string, tier int, ts_ms double"


def suppressed(signals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(session, fp, tier, ts_ms) without repeats at an equal or lower tier. ttl_ms: forget after so long, for streams that run on."""
    return signals.groupBy("session").transformWithStateInPandas(_Suppressor(ttl_ms), _SIGNAL, "Append", "ProcessingTime" if ttl_ms else "None")


def rate_limited(signals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return signals.groupBy("session").transformWithStateInPandas(_Limiter(ttl_ms), _SIGNAL, "Append", "ProcessingTime" if ttl_ms else "None")


def wait_for(stream: DataFrame, condition, timeout_s: float, checkpoint: str) -> bool:
    """Whether a row meets the condition within the time."""
    hit: list[bool] = []

    def look(frame: DataFrame, epoch: int) -> None:
        if not hit and not frame.filter(condition).isEmpty():
            hit.append(True)

    query = stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        for _ in range(max(1, round(timeout_s))):
            if hit or query.awaitTermination(1):
                break
    finally:
        query.stop()
    return bool(hit)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Everything that is there, into an in-memory table of that name."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
