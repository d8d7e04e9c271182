"""Standing predicates, suppression of repeats, and choosing what to surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tiers from low to high and the least gaps between two signals of a tier, in seconds.
TIERS = {"heartbeat": 1, "notice": 2, "alert": 3}
GAPS_S = {"heartbeat": 600, "notice": 45, "alert": 10}


def watch_hits(events: DataFrame, watches: list[dict]) -> DataFrame:
    """(watch, event_id): each watch is a name with any of category, level, source, regex. The watches are constants of the plan; each event meets all of them in one pass."""
    def test(w: dict):
        out = F.lit(True)
        for k in ("category", "level", "source"):
            if w.get(k):
                out = out & (F.col(k) == w[k])
        return out & F.col("props").rlike("(?i)" + w["regex"]) if w.get("regex") else out

    hits = F.filter(F.array(*[F.when(test(w), F.lit(w["name"])) for w in watches]), lambda x: x.isNotNull())
    return events.select("event_id", "ts_ms", F.explode(hits).alias("watch"))


def unsuppressed(signals: DataFrame, by: list[str], order: list[str], rank: str) -> DataFrame:
    """Signals of a fingerprint that are its first or of a higher tier than any before: of each tier the first row, where no row of a higher tier is earlier. Nothing is sorted but a fingerprint's tiers."""
    me = F.struct(*order, *[c for c in signals.columns if c not in order])
    firsts = signals.filter(F.col(rank).isNotNull()).groupBy(*by, F.col(rank).alias("_rank")).agg(F.min(me).alias("_me"))
    above = F.min(F.struct(*[F.col(f"_me.{o}") for o in order])).over(Window.partitionBy(*by).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, -1))
    kept = firsts.withColumn("_above", above).filter(F.col("_above").isNull() | (F.struct(*[F.col(f"_me.{o}") for o in order]) < F.col("_above")))
    return kept.select("_me.*").select(*signals.columns)


def chosen(signals: DataFrame, by: list[str], rank: str, tie: list[str], limit: int = 3) -> DataFrame:
    """Of each key's highest tier at most `limit` signals; a deadline takes one of the places and a correction comes first."""
    key = Window.partitionBy(*by)
    top = signals.withColumn("_top", F.max(rank).over(key)).filter((F.col(rank) == F.col("_top")) | F.col("correction"))
    placed = top.withColumn("_p", F.row_number().over(key.orderBy(F.desc("correction"), *tie)))
    placed = placed.withColumn("_d", F.min(F.when(F.col("deadline"), F.col("_p"))).over(key))
    late = F.coalesce(F.col("_d") > limit, F.lit(False))
    keep = F.when(late, (F.col("_p") <= limit - 1) | (F.col("_p") == F.col("_d"))).otherwise(F.col("_p") <= limit)
    return placed.filter(keep).drop("_top", "_p", "_d")


def content_identity(tier: str, *parts: str) -> "F.Column":
    """Identity of what is surfaced: tier and parts, never the prose."""
    return F.substring(F.sha1(F.concat_ws("\u0001", F.col(tier), *[F.col(p).cast("string") for p in parts])), 1, 12)


def incidents(triggers: DataFrame, ts: str, by: list[str], before_ms: int = 60_000, after_ms: int = 5_000) -> DataFrame:
    """Windows from before_ms before to after_ms after a trigger; triggers whose windows touch extend one incident."""
    from . import sequence

    out = sequence.sessions(triggers, by, ts, before_ms + after_ms + 1)
    return out.select(*by, "session", (F.col("start_ms") - before_ms).alias("from_ms"), (F.col("end_ms") + after_ms).alias("to_ms"), F.col("n").alias("triggers"))


def listed() -> "F.Column":
    """The signals of a session's state as an array of (kind, tier, fp, correction, deadline): what is worth saying, by what it says, never by its prose.

    state: running, new_errors (array of fingerprints), recurring_errors, stuck, anomaly, blank, awaiting, expiring, cleared_errors, started. Errors
    and a program that is gone alert, what goes on or needs a look is a notice, a session's start is a heartbeat.
    """
    one = lambda kind, tier, fp, when, correction=False, deadline=False: F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), fp.alias("fp"), F.lit(correction).alias("correction"), F.lit(deadline).alias("deadline")))).otherwise(F.array())
    each = lambda kind, tier, fps, correction=False: F.transform(F.coalesce(fps, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), x.alias("fp"), F.lit(correction).alias("correction"), F.lit(False).alias("deadline")))
    none = F.lit("")
    return F.concat(
        each("resolved", "notice", F.col("cleared_errors"), True), each("new_error", "alert", F.col("new_errors")), one("not_running", "alert", none, ~F.col("running")), each("recurring_error", "notice", F.col("recurring_errors")),
        one("stuck", "notice", none, F.col("stuck")), one("anomaly", "notice", none, F.col("anomaly")), one("blank", "notice", none, F.col("blank")), one("expiring", "notice", none, F.col("expiring") > 0, deadline=True), one("awaiting", "heartbeat", none, F.col("awaiting") > 0), one("started", "heartbeat", none, F.col("started")),
    )


def built(state: DataFrame, by: list[str]) -> DataFrame:
    """A session's signals as rows, with their rank and identity."""
    out = state.select(*by, F.explode(listed()).alias("s")).select(*by, "s.*")
    return out.withColumn("rank", F.coalesce(*[F.when(F.col("tier") == t, F.lit(r)) for t, r in TIERS.items()])).withColumn("identity", content_identity("tier", "kind", "fp"))


def decided(signals: DataFrame, said: DataFrame, by: list[str], now_s: float, limit: int = 3) -> DataFrame:
    """What to say now: signals without fresh repeats of equal or lower tier, then the highest tier's chosen ones, unless that tier spoke too lately.

    said: (by, kind, fp, rank, at_s) of what has been said. Corrections pass suppression; a heartbeat alone is said only where a session starts.
    """
    before = said.groupBy(*by, "kind", "fp").agg(F.max("rank").alias("_rank"))
    fresh = signals.join(before, [*by, "kind", "fp"], "left").filter(F.col("correction") | F.col("_rank").isNull() | (F.col("rank") > F.col("_rank"))).drop("_rank")
    key = Window.partitionBy(*by)
    fresh = fresh.withColumn("_top", F.max("rank").over(key)).withColumn("_start", F.max(F.col("kind") == "started").over(key))
    fresh = fresh.filter((F.col("_top") > TIERS["heartbeat"]) | F.col("_start"))
    gap = F.coalesce(*[F.when(F.col("_top") == r, F.lit(GAPS_S[t])) for t, r in TIERS.items()])
    last = said.groupBy(*by, F.col("rank").alias("_top")).agg(F.max("at_s").alias("_last"))
    open_ = fresh.join(last, [*by, "_top"], "left").filter(F.col("_last").isNull() | (F.lit(now_s) - F.col("_last") >= gap))
    return chosen(open_.drop("_top", "_start", "_last"), by, "rank", ["kind", "fp"], limit)


def retractions(tracked: DataFrame, live: DataFrame, claimed: DataFrame, by: list[str]) -> DataFrame:
    """Claims to take back: claimed or tracked, and backed by no live signal; each once, with whether it was tracked."""
    known = claimed.select(*by).withColumn("_t", F.lit(False)).unionByName(tracked.select(*by).withColumn("_t", F.lit(True))).groupBy(*by).agg(F.max("_t").alias("tracked"))
    return known.join(live.select(*by).distinct(), by, "left_anti")


def spaced(passes: DataFrame, by: str, ts: str, tie: str, gap_s: float = 5.0, unseen: str = "unseen", most: int = 20) -> DataFrame:
    """Emergency passes that may run: gap_s or more after the last one that ran, and with at most `most` frames that nobody has seen."""
    from . import sequence

    return sequence.rate_limited(passes.filter(F.col(unseen) <= most), by, ts, tie, gap_s)


def save_baseline(spark: SparkSession, path: str, key: str, set_ms: float) -> None:
    """Keep a key's baseline for later sessions; an earlier one of the key stays in the file and no longer counts."""
    spark.createDataFrame([(key, float(set_ms))], "key string, set_ms double").coalesce(1).write.mode("append").json(path)


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    """(key, set_ms): each key's latest baseline; none where nothing has been kept."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "key string, set_ms double"
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).groupBy("key").agg(F.max("set_ms").alias("set_ms"))


def since_baseline(events: DataFrame, baselines: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Events at or after their key's latest baseline (by, set_ms); keys without one give all."""
    marks = baselines.groupBy(*by).agg(F.max("set_ms").alias("_since"))
    return events.join(marks, by, "left").filter(F.col("_since").isNull() | (F.col(ts) >= F.col("_since"))).drop("_since")
