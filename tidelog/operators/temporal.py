"""Joins by time: intervals and as-of, without a theta join and without one partition for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, before_ms: int, after_ms: int, by: list[str] | None = None) -> DataFrame:
    """Each left row (ts_ms) with the right rows (r_ts_ms) from before_ms before to after_ms after it, ends included.

    Time is cut into buckets as wide as the window, so a left row looks into two or three and a right row stands in one;
    the join is an equi-join on bucket and `by`. Columns of the two sides must differ, but for `by`.
    """
    width = max(1, before_ms + after_ms)
    low, high = F.floor((F.col("ts_ms") - before_ms) / width), F.floor((F.col("ts_ms") + after_ms) / width)
    a = left.filter(F.col("ts_ms").isNotNull()).withColumn("_bucket", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    b = right.withColumn("_bucket", F.floor(F.col("r_ts_ms") / width).cast("long"))
    joined = a.join(b, [*(by or []), "_bucket"])
    return joined.filter(F.col("r_ts_ms").between(F.col("ts_ms") - before_ms, F.col("ts_ms") + after_ms)).drop("_bucket")


def _as_of(probes: DataFrame, states: DataFrame, by: list[str], bucket_ms: int, forward: bool) -> DataFrame:
    """probes + `state` struct: the last state at or before (forward: the first at or after) each probe's ts_ms.

    Within a bucket of time a window finds it; the buckets' own last states, a small table, carry over to later buckets.
    """
    sign = -1 if forward else 1
    value = F.struct(F.col("s_ts_ms"), *[F.col(c) for c in states.columns if c not in (*by, "s_ts_ms")])
    empty = F.lit(None).cast(states.select(value.alias("v")).schema["v"].dataType)
    bucket = F.floor(F.col("ts_ms") / bucket_ms).cast("long").alias("_bucket")
    rows = probes.select(*by, "ts_ms", bucket, F.lit(1).alias("_probe"), F.struct(*[F.col(c) for c in probes.columns if c not in (*by, "ts_ms")]).alias("_p"), empty.alias("_state"))
    p_type = rows.schema["_p"].dataType
    marks = states.select(*by, F.col("s_ts_ms").alias("ts_ms"), F.floor(F.col("s_ts_ms") / bucket_ms).cast("long").alias("_bucket"), F.lit(0).alias("_probe"), F.lit(None).cast(p_type).alias("_p"), value.alias("_state"))
    order = [F.col("ts_ms") * sign, F.col("_probe"), F.col("_state") if not forward else F.col("_state").desc()]
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("_here", F.last("_state", ignorenulls=True).over(inside)).filter(F.col("_probe") == 1)
    pick = F.min if forward else F.max
    per = marks.groupBy(*by, "_bucket").agg(pick("_state").alias("_best"))
    asked = rows.select(*by, "_bucket").distinct().withColumn("_best", empty)
    whole = per.unionByName(asked).groupBy(*by, "_bucket").agg(pick("_best").alias("_best"))
    before = Window.partitionBy(*by).orderBy(F.col("_bucket") * sign).rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*by, "_bucket", F.last("_best", ignorenulls=True).over(before).alias("_carry"))
    out = found.join(carry, [*by, "_bucket"], "left")
    return out.select(*by, "ts_ms", *[F.col(f"_p.{f.name}").alias(f.name) for f in p_type.fields], F.coalesce("_here", "_carry").alias("state"))


def as_of(probes: DataFrame, states: DataFrame, by: list[str], bucket_ms: int = 86_400_000) -> DataFrame:
    """The state in force at each probe. Of states at one time the largest by its columns counts."""
    return _as_of(probes, states, by, bucket_ms, False)


def nearest(probes: DataFrame, states: DataFrame, by: list[str], bucket_ms: int = 86_400_000) -> DataFrame:
    """The state nearest in time, of two equally near ones the earlier."""
    back = _as_of(probes, states, by, bucket_ms, False).withColumnRenamed("state", "_back")
    both = _as_of(back, states, by, bucket_ms, True).withColumnRenamed("state", "_ahead")
    gone, ahead = F.col("ts_ms") - F.col("_back.s_ts_ms"), F.col("_ahead.s_ts_ms") - F.col("ts_ms")
    state = F.when(F.col("_ahead").isNull() | (gone <= ahead), F.col("_back")).otherwise(F.col("_ahead"))
    return both.withColumn("state", state).drop("_back", "_ahead")
