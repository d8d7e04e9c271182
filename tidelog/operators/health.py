"""Scores over time: metrics, outliers, health, ranked hypotheses, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(rows: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Latest, smallest, largest and mean value by key."""
    return rows.groupBy(*by).agg(F.max_by(value, ts).alias("latest"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def outliers(rows: DataFrame, by: list[str], value: str, in_window: Column) -> DataFrame:
    """(mean in the window - mean of all) / standard deviation of all, per key; null where there is no spread."""
    out = rows.groupBy(*by).agg(F.avg(F.when(in_window, F.col(value))).alias("_pre"), F.avg(value).alias("_all"), F.stddev_samp(value).alias("_sd"))
    return out.select(*by, F.round("_pre", 6).alias("pre_mean"), F.round("_all", 6).alias("all_mean"), F.round(F.try_divide(F.col("_pre") - F.col("_all"), F.col("_sd")), 6).alias("z"))


def health(rows: DataFrame, by: list[str], error: Column, warning: Column, anomaly: Column) -> DataFrame:
    """0 to 100 by deductions (our weights): the error share times 150, at most 60; the warning share times 50, at most 20; 20 for any anomaly."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.count_if(warning).alias("warnings"), F.count_if(anomaly).alias("anomalies"))
    lost = F.least(F.lit(60.0), F.col("errors") / F.col("n") * 150) + F.least(F.lit(20.0), F.col("warnings") / F.col("n") * 50) + F.when(F.col("anomalies") > 0, 20.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100 - lost)
    return out.withColumn("score", F.round(score, 4)).withColumn("grade", F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 50, "C").otherwise("D"))


def hypotheses(groups: DataFrame, severity: Column, last_ms: str, n: str, now_ms: float, top: int = 6) -> DataFrame:
    """The strongest groups by severity x recency (half after a day) x recurrence, ranked; the limit is the report."""
    age = F.greatest(F.lit(0.0), (F.lit(float(now_ms)) - F.col(last_ms)) / 86_400_000.0)
    score = F.round(severity * F.pow(F.lit(0.5), age) * F.log2(F.col(n) + 1), 6)
    return groups.withColumn("score", score)


def top(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    best = rows.orderBy(F.desc(score), tie).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def freshness(rows: DataFrame, source: str, ts: str, own: Column, now_ms: float, stale_ms: float) -> DataFrame:
    """Per source: age of the last record that is the program's own, self-emitted and untimed counts, and whether it is stale. Silence counts from the program's records."""
    out = rows.groupBy(source).agg(F.max(F.when(~own, F.col(ts))).alias("last_ms"), F.count_if(own).alias("self_emitted"), F.count_if(F.col(ts).isNull()).alias("untimed"), F.count("*").alias("n"))
    return out.withColumn("age_ms", F.lit(now_ms) - F.col("last_ms")).withColumn("stale", F.coalesce(F.col("age_ms") > stale_ms, F.lit(True)))


def rollup(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts over all prefixes of the keys; an extension."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping_id"))


def error_rate(rows: DataFrame, by: list[str], order: list[str], error: Column, last: int = 50) -> DataFrame:
    """The share of errors among each key's last rows."""
    recent = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]))).filter(F.col("_i") <= last)
    return recent.groupBy(*by).agg(F.round(F.avg(F.when(error, 1.0).otherwise(0.0)), 6).alias("error_rate"), F.count("*").alias("n"))


def ranked_outliers(rows: DataFrame, by: list[str], fields: list[str], in_window: Column, top_n: int = 3) -> DataFrame:
    """Each key's fields by how far their mean in the window is from that of all, in standard deviations: (by, rank, field, z)."""
    sums = [a for f in fields for a in (F.avg(F.when(in_window, F.col(f))).alias(f"_p_{f}"), F.avg(f).alias(f"_a_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))]
    out = rows.groupBy(*by).agg(*sums)
    z = F.array(*[F.struct(F.lit(f).alias("field"), F.round(F.try_divide(F.col(f"_p_{f}") - F.col(f"_a_{f}"), F.col(f"_s_{f}")), 6).alias("z")) for f in fields])
    out = out.select(*by, F.explode(F.filter(z, lambda x: x["z"].isNotNull())).alias("x")).select(*by, "x.field", "x.z")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("z")), "field"))).filter(F.col("rank") <= top_n)
