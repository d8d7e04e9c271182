"""Error fingerprints: histograms, novelty, trends, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import sequence
from .state import map_delta


def histogram(rows: DataFrame, message: str, ts: str, source: str) -> DataFrame:
    """By fingerprint: count, a sample, its source, first and last. Partial sums before the shuffle; the sample is the smallest message."""
    # the filter stands on the message: one on the fingerprint would be worked out a second time below the projection
    marked = rows.filter(F.col(message) != "").withColumn("fp", text.fingerprint(F.col(message)))
    return marked.groupBy("fp").agg(F.count("*").alias("n"), F.min(message).alias("sample"), F.min(source).alias("source"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def of_fingerprint(rows: DataFrame, message: str, fp: str | Column) -> DataFrame:
    """The rows whose message has this fingerprint."""
    return rows.filter((F.col(message) != "") & (text.fingerprint(F.col(message)) == fp))


def new_since(counted: DataFrame, start) -> DataFrame:
    return counted.filter(F.col("first_seen") >= start)


def trend(rows: DataFrame, by: list[str], order: list[str], is_error: Column, frames: int = 20) -> DataFrame:
    """Errors in the older and the newer half of each key's last `frames` rows: rising, falling, steady, or unknown below 4 rows."""
    recent = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]))).filter(F.col("_i") <= frames)
    n = F.count("*").over(Window.partitionBy(*by))
    halves = recent.withColumn("_new", F.col("_i") <= F.floor(n / 2)).withColumn("_e", F.when(is_error, 1).otherwise(0))
    out = halves.groupBy(*by).agg(F.count("*").alias("frames"), F.sum(F.when(F.col("_new"), F.col("_e")).otherwise(0)).alias("newer"), F.sum(F.when(~F.col("_new"), F.col("_e")).otherwise(0)).alias("older"))
    return out.withColumn("trend", F.when(F.col("frames") < 4, "unknown").when(F.col("newer") > F.col("older"), "rising").when(F.col("newer") < F.col("older"), "falling").otherwise("steady"))


def occurrences(rows: DataFrame, fp: str, order: list[str], identity: str, width: float = sequence.STRETCH_MS) -> DataFrame:
    """Per fingerprint how often its block's text changed: a block that is read again does not count again. width: of the stretches in which a fingerprint's rows are sorted."""
    before = F.col(f"_p.{identity}")
    return sequence.with_previous(rows, [fp], order, [identity], width).withColumn("_new", F.when(before.isNull() | (before != F.col(identity)), 1).otherwise(0)).groupBy(fp).agg(F.sum("_new").alias("occurrences"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only a has (resolved) and that only b has (new)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("change", F.lit("resolved")).union(y.join(x, key, "left_anti").withColumn("change", F.lit("new")))


def recovery(rows: DataFrame, operation: str, failed: Column, ok: Column, state: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Operations that both failed and succeeded, and how often; with a state (a map) and an order also what the last success changed against the last failure."""
    aggregates = [F.count_if(failed).alias("failed"), F.count_if(ok).alias("succeeded")]
    if state:
        at = F.struct(*order)
        aggregates += [F.max_by(F.when(failed, F.col(state)), F.when(failed, at)).alias("_bad"), F.max_by(F.when(ok, F.col(state)), F.when(ok, at)).alias("_good")]
    out = rows.groupBy(operation).agg(*aggregates).filter((F.col("failed") > 0) & (F.col("succeeded") > 0))
    return out.withColumn("changed", map_delta(F.col("_bad"), F.col("_good"))["changed"]).drop("_bad", "_good") if state else out


def swallowed(rows: DataFrame) -> DataFrame:
    """Handled exceptions by (run_ms, site, kind, n): kind summary outranks live rows of its run and site; only the newest run of each site counts."""
    per = rows.groupBy("site", "run_ms").agg(F.max(F.when(F.col("kind") == "summary", F.col("n"))).alias("_sum"), F.sum(F.when(F.col("kind") != "summary", F.col("n"))).alias("_live"))
    return per.groupBy("site").agg(F.max("run_ms").alias("run_ms"), F.max_by(F.coalesce("_sum", "_live"), "run_ms").alias("n"))
