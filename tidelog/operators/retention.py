"""What to keep: frame priorities, eviction plans and the ledger's totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priorities up to which each mode wants a frame seen.
MODES = {"off": -1, "errors": 1, "changes": 3, "all": 4}


def assess(error: Column, incident: Column, failure: Column, screen_error: Column, score: Column, unreadable: Column, mode: str = "changes") -> tuple[Column, Column, Column]:
    """(priority 0 to 4, interest 0 to 1, needs_eyes) of a frame's facts."""
    static = score < 0.008
    priority = F.when(error | incident, 0).when(failure | screen_error, 1).when(score >= 0.25, 2).when(~static | unreadable, 3).otherwise(4)
    base = F.when(priority == 0, 1.0).when(priority == 1, 0.85).when(priority == 2, 0.6).when(priority == 3, 0.35).otherwise(0.05)
    interest = F.least(F.lit(1.0), base + F.least(F.lit(0.10), F.coalesce(score, F.lit(0.0)) / 10))
    eyes = (priority <= MODES[mode]) & ~((priority == 3) & static & unreadable)
    return priority, F.round(interest, 4), eyes


def triage(running: Column, has_error: Column, occurrences: Column, stuck: Column, anomaly: Column, anomaly_confidence: Column, changed: Column) -> tuple[Column, Column]:
    """(summary tag, confidence): the first of not running, error, stuck, anomaly, healthy that holds."""
    tag = F.when(~running, "not_running").when(has_error & (occurrences > 1), "error,recurring").when(has_error, "error").when(stuck, "stuck").when(anomaly, "anomaly").when(changed, "healthy,state_changed").otherwise("healthy")
    confidence = F.when(~running, 0.3).when(has_error, 0.2).when(stuck, 0.5).when(anomaly, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(anomaly_confidence, F.lit(0.6))))).otherwise(0.85)
    return tag, confidence


def eviction(ledger: DataFrame, size: str, tier: Column, interest: str, ts: str, tie: str, budget: int, high: float = 0.9, low: float = 0.75) -> DataFrame:
    """Rows to evict: nothing while `high` of the budget is not used, else in order of (tier, interest, ts) until `low` of it is left. Tier 3 never goes, tier 2 not under normal pressure.

    A row goes while what is left before it still exceeds the target. The running total is taken per range of the order first, so no task sorts the whole ledger.
    """
    used = ledger.agg(F.sum(size).alias("_used"))
    rows = ledger.withColumn("_tier", tier).filter(F.col("_tier") <= 1)
    rows = rows.withColumn("_slot", F.floor(F.col(interest) * 1000).cast("long"))
    per = rows.groupBy("_tier", "_slot").agg(F.sum(size).alias("_s"))
    before = per.select("_tier", "_slot", (F.sum("_s").over(Window.orderBy("_tier", "_slot")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy("_tier", "_slot").orderBy(interest, ts, tie)
    out = rows.join(before, ["_tier", "_slot"]).withColumn("freed_before", F.col("_before") + F.sum(size).over(w) - F.col(size))
    out = out.crossJoin(F.broadcast(used)).filter((F.col("_used") >= high * budget) & (F.col("_used") - F.col("freed_before") > low * budget))
    return out.drop("_slot", "_before", "_used").withColumnRenamed("_tier", "tier")


def ledger_report(ledger: DataFrame, size: str, state: Column) -> DataFrame:
    return ledger.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def awaiting(ledger: DataFrame, now_ms: float, hold_ms: float = 900_000, limit: int = 50) -> DataFrame:
    """Frames that need eyes, have had none and have not run out of time: by priority, newest first."""
    open_ = F.col("needs_eyes") & F.col("examined_ms").isNull() & (F.col("ts_ms") + hold_ms > now_ms)
    return ledger.filter(open_).orderBy("priority", F.desc("ts_ms"), "seq").limit(limit)


def eviction_low_disk(ledger: DataFrame, size: str, tier: Column, interest: str, ts: str, tie: str, budget: int, archive: int = 0, most_awaiting: int = 20) -> DataFrame:
    """The plan when the disk runs low: down to the lesser of 75 % of the budget and half of what is used, less what the archive holds (a tenth of the budget at most); up to most_awaiting rows of tier 2 may go last."""
    used = ledger.agg(F.sum(size)).first()[0] or 0
    target = max(0.0, min(0.75 * budget, 0.5 * used) - min(archive, 0.1 * budget))
    rows = ledger.withColumn("_tier", tier).filter(F.col("_tier") <= 2)
    waiting = rows.filter(F.col("_tier") == 2).orderBy(interest, ts, tie).limit(most_awaiting)
    rows = rows.filter(F.col("_tier") < 2).unionByName(waiting)
    rows = rows.withColumn("_slot", F.floor(F.col(interest) * 1000).cast("long"))
    per = rows.groupBy("_tier", "_slot").agg(F.sum(size).alias("_s"))
    before = per.select("_tier", "_slot", (F.sum("_s").over(Window.orderBy("_tier", "_slot")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy("_tier", "_slot").orderBy(interest, ts, tie)
    out = rows.join(before, ["_tier", "_slot"]).withColumn("freed_before", F.col("_before") + F.sum(size).over(w) - F.col(size))
    return out.filter(F.lit(used) - F.col("freed_before") > target).drop("_slot", "_before").withColumnRenamed("_tier", "tier")


def unmet(ledger: DataFrame, plan: DataFrame, size: str, target: float) -> DataFrame:
    """One row: bytes used, bytes that the plan frees and bytes above the target that remain."""
    used, freed = ledger.agg(F.coalesce(F.sum(size), F.lit(0)).alias("used")), plan.agg(F.coalesce(F.sum(size), F.lit(0)).alias("freed"))
    return used.crossJoin(F.broadcast(freed)).withColumn("unmet", F.greatest(F.lit(0.0), F.col("used") - F.col("freed") - F.lit(float(target))))  # one row each


def self_evaluation(running: Column, has_error: Column, has_log: Column, has_image: Column, unreadable: Column) -> tuple[Column, Column]:
    """(confidence, why) of a snapshot in what it can tell, by what it lacks: our ladder."""
    ladder = [(~running, 0.3, "not running"), (~has_log & ~has_image, 0.2, "nothing to see"), (unreadable & ~has_log, 0.4, "screen unreadable and no log"), (has_error, 0.9, "error seen"), (~has_log, 0.6, "no log"), (~has_image, 0.7, "no image")]
    confidence, why = None, None
    for test, c, w in ladder:
        confidence = F.when(test, c) if confidence is None else confidence.when(test, c)
        why = F.when(test, w) if why is None else why.when(test, w)
    return confidence.otherwise(0.85), why.otherwise("complete")


def collapse_totals(rows: DataFrame, chars: str, repeat: str) -> DataFrame:
    """One row: estimated tokens before and after repeats collapse into one line each, and the share saved."""
    tokens = F.ceil(F.col(chars) / 4).cast("long")
    out = rows.agg(F.sum(tokens * F.col(repeat)).alias("tokens_before"), F.sum(tokens).alias("tokens_after"), F.count("*").alias("rows"))
    return out.withColumn("saved", F.round(1 - F.try_divide(F.col("tokens_after"), F.col("tokens_before")), 6))


def progression(rows: DataFrame, by: list[str], order: list[str], value: str, last: int = 100, least: float = 0.1) -> DataFrame:
    """First and last of each key's last rows, and whether the value is rising, falling or steady by at least that share."""
    recent = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]))).filter(F.col("_i") <= last)
    out = recent.groupBy(*by).agg(F.max_by(value, "_i").alias("first"), F.min_by(value, "_i").alias("last"), F.count("*").alias("n"))
    moved = F.try_divide(F.col("last") - F.col("first"), F.abs("first"))
    return out.withColumn("trend", F.when(moved > least, "rising").when(moved < -least, "falling").otherwise("steady"))
