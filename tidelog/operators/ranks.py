"""Places and exact medians in keys of any size: no task sorts or holds a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks that a summary of a key tells apart; the exact step looks at four of so many parts of the key.
ACCURACY = 10_000
#: Rows of a key that one task may hold and sort.
KEY_ROWS = 100_000


def bounded(rows: DataFrame, by: list[str], most: int = KEY_ROWS) -> bool:
    """Whether no key has more than `most` rows: one count, by which a plan that holds a key in one task may be chosen."""
    return rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).isEmpty()


def with_place(rows: DataFrame, by: list[str], order: list[str], width: float, place: str = "_i", total: str | None = None, small: bool = False) -> DataFrame:
    """Rows + their place from 1 in the order of their key (and the key's rows). small: keys are known to be `bounded`, one window will do. Else each stretch of `width` of the order's first column is sorted by itself, and the counts of the stretches before are added."""
    if small:
        out = rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count("*").over(Window.partitionBy(*by))) if total else out
    cut = rows.withColumn("_b", F.floor(F.col(order[0]) / width).cast("long"))
    counts = cut.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*by).orderBy("_b")
    base = counts.select(*by, "_b", (F.sum("_m").over(w) - F.col("_m")).alias("_base"), *([F.sum("_m").over(Window.partitionBy(*by)).alias(total)] if total else []))
    within = cut.withColumn("_w", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    return within.join(base, [*by, "_b"]).withColumn(place, F.col("_base") + F.col("_w")).drop("_b", "_w", "_base")


def medians(rows: DataFrame, by: list[str], value: str, out: str = "median", accuracy: int = ACCURACY, small: bool = False) -> DataFrame:
    """(by, out): the exact median of each key's values, the mean of the middle two of an even number, as `median` gives it; null for keys of nulls. small: keys are known to be `bounded`.

    A mergeable summary bounds the middle from both sides to within 2 / accuracy of the ranks; values outside the bounds are counted, and those inside
    are counted by value and ranked. So a key's values meet nowhere, and a repeated value is one row.
    """
    v = F.col(value).cast("double")
    if small:
        return rows.groupBy(*by).agg(F.median(v).alias(out))
    data = rows.select(*by, v.alias("_v"))
    step = 2.0 / accuracy
    ends = data.groupBy(*by).agg(F.percentile_approx("_v", [0.5 - step, 0.5 + step], accuracy).alias("_e"), F.count("_v").alias("_n"))
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.get("_e", 0).alias("_low"), F.get("_e", 1).alias("_high"), "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    placed = data.filter(F.col("_v").isNotNull()).join(ends, on)
    # what lies below counts as one row; what lies above matters to nobody
    shown = placed.filter(F.col("_v") <= F.col("_high")).withColumn("_v", F.when(F.col("_v") >= F.col("_low"), F.col("_v")))
    per = shown.groupBy(*by, "_v", "_n").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    ranked = per.withColumn("_to", upto).withColumn("_from", upto - F.col("_m"))
    holds = lambda r: (F.col("_from") < r) & (r <= F.col("_to"))
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    middle = ranked.groupBy(*by).agg(((F.max(F.when(holds(first), F.col("_v"))) + F.max(F.when(holds(second), F.col("_v")))) / 2).alias(out))
    keys = ends.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)])
    found = middle.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], out)
    return keys.join(found, on, "left").select(*by, out)
