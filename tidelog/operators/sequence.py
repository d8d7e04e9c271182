"""Runs, streaks, sessions and other operators on neighbouring rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage, ranks

#: Width of a stretch of time, in milliseconds, where none is given; and rows of a run that are looked at within one array.
STRETCH_MS, RUN_ROWS = 86_400_000.0, 1024


def islands(rows: DataFrame, by: list[str], order: list[str], same: Column) -> DataFrame:
    """rows + `island`: numbers runs from 1; a run goes on while `same` (about a row and its predecessor) holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_start", starts).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def with_previous(rows: DataFrame, by: list[str], order: list[str], columns: list[str], width: float) -> DataFrame:
    """rows + _b, the stretch of `width` of the order's first column, and _p, the columns of the row before as a struct, null at a key's first row.

    Each stretch is sorted by itself and only stretches' last rows are carried over, so a key's history never meets in one task.
    """
    cut = rows.withColumn("_b", F.floor(F.col(order[0]) / width).cast("long"))
    value, at = F.struct(*columns), F.struct(*order)
    lasts = cut.groupBy(*by, "_b").agg(F.max_by(value, at).alias("_l"))
    carried = lasts.select(*by, "_b", F.lag("_l").over(Window.partitionBy(*by).orderBy("_b")).alias("_c"))
    inner = cut.withColumn("_p", F.lag(value).over(Window.partitionBy(*by, "_b").orderBy(*order)))
    return inner.join(carried, [*by, "_b"]).withColumn("_p", F.coalesce("_p", "_c")).drop("_c")


def numbered_runs(rows: DataFrame, by: list[str], order: list[str], same: Column) -> DataFrame:
    """`with_previous` rows + island: runs are counted within each stretch and the counts of the stretches before are added. same: about a row and _p."""
    marked = rows.withColumn("_start", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1).cast("long"))
    counts = marked.groupBy(*by, "_b").agg(F.sum("_start").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b")
    base = counts.select(*by, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_base"))
    within = F.sum("_start").over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", within).join(base, [*by, "_b"]).withColumn("island", F.col("island") + F.col("_base")).drop("_start", "_base", "_b", "_p")


def before(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def run_lengths(rows: DataFrame, by: list[str], order: list[str], value: str, width: float | None = None) -> DataFrame:
    """Runs of equal values: by, island, value, repeat and the first and last of the order's first column. width: see with_previous; for keys with long histories."""
    if width:
        cut = with_previous(rows, by, order, [value], width)
        runs = numbered_runs(cut, by, order, F.col("_p").isNotNull() & F.col(f"_p.{value}").eqNullSafe(F.col(value)))
        return runs.groupBy(*by, "island").agg(F.first(value).alias(value), F.count("*").alias("repeat"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    runs = islands(rows, by, order, F.col(value).eqNullSafe(before(value, by, order)) & F.lag(F.lit(1)).over(Window.partitionBy(*by).orderBy(*order)).isNotNull())
    return runs.groupBy(*by, "island").agg(F.first(value).alias(value), F.count("*").alias("repeat"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def streaks(rows: DataFrame, by: list[str], order: list[str], value: str, least: int, width: float | None = None) -> DataFrame:
    return run_lengths(rows, by, order, value, width).filter(F.col("repeat") >= least)


def stuck(rows: DataFrame, by: list[str], order: list[str], distance: str, size: str, near: int = 2, least: int = 5, width: float = STRETCH_MS) -> DataFrame:
    """Rows at which `least` consecutive distances are at most `near` while the log has not grown since the streak's start."""
    placed = ranks.with_place(rows, by, order, width, "_at")
    runs = numbered_runs(with_previous(placed, by, order, [distance], width), by, order, (F.col(distance) <= near) & (F.col(f"_p.{distance}") <= near))
    begins = runs.groupBy(*by, "island").agg(F.min("_at").alias("_first"), F.min_by(size, "_at").alias("_from"))
    out = _with(runs, begins, [*by, "island"]).withColumn("streak", F.col("_at") - F.col("_first") + 1)
    return out.filter((F.col(distance) <= near) & (F.col("streak") >= least) & (F.col(size) <= F.col("_from"))).drop("_from", "_first", "_at", "island")


def sessions(rows: DataFrame, by: list[str], ts: str, gap_ms: int, *ties: str, width: float | None = None) -> DataFrame:
    """Gaps of gap_ms or more end a session: by, session, start, end and rows."""
    order = [ts, *ties]
    if width:
        runs = numbered_runs(with_previous(rows, by, order, [ts], width), by, order, F.col(ts) - F.col(f"_p.{ts}") < gap_ms)
    else:
        runs = islands(rows, by, order, F.col(ts) - before(ts, by, order) < gap_ms)
    return runs.groupBy(*by, F.col("island").alias("session")).agg(F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.count("*").alias("n"))


def deltas(rows: DataFrame, by: list[str], order: list[str], value: str, width: float | None = None) -> DataFrame:
    if width:
        return with_previous(rows, by, order, [value], width).withColumn("delta", F.round(F.col(value) - F.col(f"_p.{value}"), 4)).drop("_b", "_p")
    return rows.withColumn("delta", F.round(F.col(value) - before(value, by, order), 4))


def error_runs(rows: DataFrame, by: list[str], order: list[str], is_error: Column, window: int = 3, width: float = STRETCH_MS) -> DataFrame:
    """Rows at which the last `window` rows are all errors."""
    placed = ranks.with_place(rows.withColumn("_e", F.coalesce(is_error, F.lit(False))), by, order, width, "_at")
    runs = numbered_runs(with_previous(placed, by, order, ["_e"], width), by, order, F.col("_p._e") == F.col("_e")).filter("_e")
    begins = runs.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("island").alias("_run")).agg(F.min("_at").alias("_first"))
    on = F.col("island") == F.col("_run")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return runs.join(begins, on).filter(F.col("_at") - F.col("_first") >= window - 1).select(*rows.columns)


def every_nth(rows: DataFrame, by: list[str], order: list[str], n: int, width: float = STRETCH_MS) -> DataFrame:
    """The 1st, (n+1)th, ... row of each key."""
    return ranks.with_place(rows, by, order, width).filter((F.col("_i") - 1) % n == 0).drop("_i")


def slope(rows: DataFrame, by: list[str], ts: str, value: str, window_ms: int) -> DataFrame:
    """Last value minus the first within the last window_ms of each key."""
    last = rows.groupBy(*by).agg(F.max(ts).alias("_last"))
    recent = rows.join(last, by).filter(F.col(ts) >= F.col("_last") - window_ms)
    return recent.groupBy(*by).agg(F.round(F.max_by(value, ts) - F.min_by(value, ts), 6).alias("rise"), F.count("*").alias("n"))


def _with(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the facts of their key; a null key is a key."""
    named = facts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in facts.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on).drop(*[f"_k{i}" for i in range(len(by))])


def sag(rows: DataFrame, by: list[str], order: list[str], value: str, width: float = STRETCH_MS) -> DataFrame:
    """The newer half's minimum against the median of all: sag_pct."""
    low = F.min(F.when(F.col("_i") > F.col("_n") / 2, F.col(value))).alias("low")
    if ranks.bounded(rows, by):
        out = ranks.with_place(rows, by, order, width, "_i", "_n", small=True).groupBy(*by).agg(F.median(value).alias("median"), low)
    else:
        out = _with(ranks.with_place(rows, by, order, width, "_i", "_n").groupBy(*by).agg(low), ranks.medians(rows, by, value), by)
    return out.select(*by, F.round("median", 6).alias("median"), F.round("low", 6).alias("low"), F.round(F.try_divide(F.col("median") - F.col("low"), F.col("median")) * 100, 4).alias("sag_pct"))


def spikes(rows: DataFrame, by: list[str], order: list[str], value: str, ratio: float = 1.5, least: int = 5) -> DataFrame:
    """Keys whose last value is `ratio` times the median of the earlier ones or more, of `least` rows at least."""
    last = rows.groupBy(*by).agg(F.max(F.struct(*order)).alias("_last"), F.max_by(value, F.struct(*order)).alias("latest"), F.count("*").alias("n")).filter(F.col("n") >= least)
    earlier = _with(rows, last.select(*by, "_last"), by).filter(F.struct(*order) < F.col("_last"))
    out = _with(last, ranks.medians(earlier, by, value, small=ranks.bounded(rows, by)), by)
    return out.filter(F.col("latest") >= ratio * F.col("median")).select(*by, F.round("latest", 6).alias("latest"), F.round("median", 6).alias("median"), "n")


def rate_limited(rows: DataFrame, by: str, ts: str, tie: str, gap: float, run_rows: int = RUN_ROWS) -> DataFrame:
    """(by, ts, tie) of the rows accepted when each must be `gap` or more after the last accepted one of its key, in order of (ts, tie); rows without a time are left out.

    A key of up to run_rows rows is gone through within one array. In a larger one a row after a silence of `gap` is accepted whatever came before, so what lies
    between two silences is a run of its own; runs of up to run_rows rows are gone through in the same way, and in longer ones each row points at the first row
    `gap` later, and the pointers are doubled until all that the run's first row reaches is found.
    """
    data = rows.select(by, ts, tie).filter(F.col(ts).isNotNull())
    large = data.groupBy(F.col(by).alias("_large")).agg(F.count("*").alias("_n")).filter(F.col("_n") > run_rows).select("_large")
    if large.isEmpty():
        return _accepted(data, [by], ts, tie, gap).select(by, ts, tie)
    same = F.col(by).eqNullSafe(F.col("_large"))
    few, data = data.join(large, same, "left_anti"), data.join(large, same, "left_semi")
    runs = numbered_runs(with_previous(data, [by], [ts, tie], [ts], 64.0 * gap), [by], [ts, tie], F.col(ts) - F.col(f"_p.{ts}") < gap)
    sized = _with(runs, runs.groupBy(by, "island").agg(F.count("*").alias("_size")), [by, "island"])
    short = sized.filter(F.col("_size") <= run_rows).select(by, ts, tie, "island")
    accepted = _accepted(few, [by], ts, tie, gap).select(by, ts, tie).unionByName(_accepted(short, [by, "island"], ts, tie, gap).select(by, ts, tie))
    long = sized.filter(F.col("_size") > run_rows).select(by, ts, tie, "island")
    if long.isEmpty():
        return accepted
    return accepted.unionByName(_reached(long, [by, "island"], ts, tie, gap).select(by, ts, tie))


def _accepted(rows: DataFrame, by: list[str], ts: str, tie: str, gap: float) -> DataFrame:
    """The accepted rows of keys that fit an array."""
    kind, other = rows.schema[ts].dataType.simpleString(), rows.schema[tie].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<struct<{ts}:{kind},{tie}:{other}>>").alias("kept"))
    step = lambda acc, r: F.when(acc["last"].isNull() | (r[ts] - acc["last"] >= gap), F.struct(r[ts].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept"))).otherwise(acc)
    of = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(ts, tie))).alias("_r"))
    return of.select(*by, F.explode(F.aggregate("_r", start, step)["kept"]).alias("r")).select(*by, F.col(f"r.{ts}").alias(ts), F.col(f"r.{tie}").alias(tie))


def successors(rows: DataFrame, by: list[str], ts: str, tie: str, gap: float) -> DataFrame:
    """Rows + _next, the first row of their key `gap` or more later as (ts, tie); null at the end. Time is cut into cells of the gap: the row sought is in the next cell, or else the first of the next cell that has rows."""
    cells = rows.withColumn("_cell", F.floor(F.col(ts) / gap).cast("long"))
    me = F.struct(F.col(ts), F.col(tie))
    # what asks stands among the rows of the next cell at its own time plus the gap
    asked = cells.select(*by, (F.col("_cell") + 1).alias("_cell"), (F.col(ts) + gap).alias("_at"), F.lit(0).alias("_row"), me.alias("_me"))
    there = cells.select(*by, "_cell", F.col(ts).alias("_at"), F.lit(1).alias("_row"), me.alias("_me"))
    w = Window.partitionBy(*by, "_cell").orderBy("_at", "_row", "_me").rowsBetween(1, Window.unboundedFollowing)
    found = asked.unionByName(there).withColumn("_near", F.first(F.when(F.col("_row") == 1, F.col("_me")), ignorenulls=True).over(w)).filter(F.col("_row") == 0)
    firsts = cells.groupBy(*by, "_cell").agg(F.min(me).alias("_first")).withColumn("_down", -F.col("_cell"))
    one = with_previous(firsts, by, ["_down"], ["_cell", "_first"], 4096.0).withColumn("_one", F.col("_p")).drop("_b", "_p")
    two = with_previous(one, by, ["_down"], ["_one"], 4096.0)
    far = F.when(F.col("_one._cell") == F.col("_cell") + 1, F.col("_p._one._first")).otherwise(F.col("_one._first"))
    after = two.select(*by, (F.col("_cell") + 1).alias("_cell"), far.alias("_far"))
    return _with(found, after, [*by, "_cell"]).select(*by, F.col(f"_me.{ts}").alias(ts), F.col(f"_me.{tie}").alias(tie), F.coalesce("_near", "_far").alias("_next"))


def _reached(rows: DataFrame, by: list[str], ts: str, tie: str, gap: float) -> DataFrame:
    """Rows that the first row of each key reaches by its pointers: after k rounds those of up to 2**k steps are known, and every pointer spans 2**k."""
    points = lineage.cut(successors(rows, by, ts, tie, gap).withColumn("_me", F.struct(F.col(ts), F.col(tie))).select(*by, "_me", "_next"))
    found = lineage.cut(points.groupBy(*by).agg(F.min("_me").alias("_me")))
    while True:
        ahead = points.filter(F.col("_next").isNotNull())
        further = found.join(ahead, [*by, "_me"]).select(*by, F.col("_next").alias("_me"))
        if further.isEmpty():
            return found.select(*by, F.col(f"_me.{ts}").alias(ts), F.col(f"_me.{tie}").alias(tie))
        found = lineage.cut(found.unionByName(further).distinct())
        onward = ahead.select(*by, F.col("_me").alias("_next"), F.col("_next").alias("_then"))
        points = lineage.cut(ahead.join(onward, [*by, "_next"]).select(*by, "_me", F.col("_then").alias("_next")))
