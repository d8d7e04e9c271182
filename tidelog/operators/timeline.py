"""Filters, merges and limits over the one timeline of events."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels


def in_window(events: DataFrame, start_ms: float, end_ms: float, keep_untimed: bool = True, stamp: str | None = None) -> DataFrame:
    """Rows from start to end, both included; rows without a time pass unless told otherwise.

    stamp: a timestamp column without zone (in UTC) instead of ts_ms; a filter on a stored column reaches the scan.
    """
    c, low, high = F.col("ts_ms"), start_ms, end_ms
    if stamp:
        c, (low, high) = F.col(stamp), (F.lit(datetime.fromtimestamp(x / 1000, UTC).replace(tzinfo=None)).cast("timestamp_ntz") for x in (start_ms, end_ms))
    inside = c.between(low, high)
    return events.filter(c.isNull() | inside if keep_untimed else inside)


def labelled(events: DataFrame, label: str) -> DataFrame:
    """Rows of exactly this label; an empty one filters nothing."""
    return events.filter(F.col("log_label") == label) if label else events


def at_least(events: DataFrame, level: str) -> DataFrame:
    """Rows of that rank or above; a filter level without a rank filters nothing, an event level without one counts 0."""
    rank = levels.LEVEL_RANK.get(level.upper(), 0)
    return events.filter(levels.level_rank(F.col("level")) >= rank) if rank else events


def in_order(events: DataFrame, *ties: str) -> DataFrame:
    """By time, rows without one last, then by the tie columns."""
    return events.orderBy(F.asc_nulls_last("ts_ms"), *ties)


def latest(events: DataFrame, n: int, *ties: str) -> DataFrame:
    """The last n rows of the timeline; rows without a time stand at its end and so count among them."""
    return events.orderBy(F.desc_nulls_first("ts_ms"), *[F.desc(t) for t in ties]).limit(n)


def merged(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def search(rows: DataFrame, column: str, query: str, regex: bool = False, level: str = "", category: str = "", trace_id: str = "") -> DataFrame:
    """Rows whose column holds the query, upper or lower case, of at least this level, of this category and trace where they are given.

    A query that is no regular expression is looked for as it stands.
    """
    if regex:
        try:
            re.compile(query)
        except re.error:
            regex = False
    c = F.col(column)
    out = rows.filter(c.rlike("(?i)" + query) if regex else F.contains(F.lower(c), F.lit(query.lower()))) if query else rows
    out = at_least(out, level) if level else out
    out = out.filter(F.col("category") == category) if category else out
    return out.filter(F.col("trace_id") == trace_id) if trace_id else out


def of_traces(events: DataFrame, wanted: Column, order: list[str], trace: str = "trace_id") -> DataFrame:
    """All events of the traces of which any event is wanted, with their step in the trace's order; an event without a trace belongs to none."""
    traces = events.filter(wanted & F.col(trace).isNotNull()).select(trace).distinct()
    return events.join(traces, trace, "left_semi").withColumn("step", F.row_number().over(Window.partitionBy(trace).orderBy(*order)))


def range_query(events: DataFrame, start_ms: float, end_ms: float, category: str = "", source: str = "") -> DataFrame:
    """Category exactly, source as a part of the name."""
    out = events.filter(F.col("ts_ms").between(start_ms, end_ms))
    out = out.filter(F.col("category") == category) if category else out
    return out.filter(F.contains("source", F.lit(source))) if source else out


def failure_trigger() -> Column:
    """Error category, a run.fail event, or a source named after a failure."""
    named = F.get_json_object("props", "$.name") == "run.fail"
    return (F.col("category") == "error") | F.coalesce(named, F.lit(False)) | F.lower("source").rlike("fail|error|crash")


def without_own(lines: DataFrame, markers: list[str], column: str = "line") -> DataFrame:
    """Lines that hold none of the observer's own markers."""
    return lines.filter(reduce(lambda a, b: a & b, [~F.contains(F.col(column), F.lit(m)) for m in markers], F.lit(True)))


def up_to_offset(rows: DataFrame, offset: int) -> DataFrame:
    """Rows (of `tail`'s readers) that were complete at a pinned byte offset; 0 pins nothing."""
    return rows.filter(F.col("end") <= offset) if offset else rows


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def vocabulary(events: DataFrame) -> DataFrame:
    """Distinct (category, name) with counts and first and last time."""
    name = F.coalesce(F.get_json_object("props", "$.name"), F.lit(""))
    return events.groupBy("category", name.alias("name")).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def signature(text: Column) -> Column:
    """A line without its leading channel tag and without numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\[[^\]]*\]\s*", ""), r"[0-9]+", "N"))


def exclusive_signatures(lines: DataFrame, label: str, text: str) -> DataFrame:
    """Signatures that one source alone has, with the source and the count; distinct per source first, so no source's rows meet in one task."""
    per = lines.select(F.col(label).alias("label"), signature(F.col(text)).alias("signature")).groupBy("signature", "label").agg(F.count("*").alias("n"))
    return per.groupBy("signature").agg(F.count("*").alias("labels"), F.first("label").alias("label"), F.sum("n").alias("n")).filter(F.col("labels") == 1).select("signature", "label", "n")
