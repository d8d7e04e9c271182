"""Records of several lines: where they start, which format they are in, and their fields.

Lines are cut into stretches of a fixed number of lines. A stretch counts its own
record starts, and the counts of the stretches before are added, so a record that
runs over an edge keeps its number and no task sorts a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeparse
from . import parsing

#: Lines in a stretch, records of a file by which its format is decided, and lines looked at for that.
STRETCH, SAMPLE_RECORDS, SAMPLE_LINES = 65_536, 30, 400


def numbered(lines: DataFrame, by: list[str], order: str, starts: Column, stretch: int = STRETCH) -> DataFrame:
    """Lines + record_no: how many records of the file have started up to each line. Lines before the first start are record 0."""
    marked = lines.withColumn("_s", F.floor(F.col(order) / stretch).cast("long")).withColumn("_start", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0).cast("long"))
    counts = marked.groupBy(*by, "_s").agg(F.sum("_start").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_s")
    base = counts.select(*by, "_s", (F.sum("_n").over(w) - F.col("_n")).alias("_base"))
    within = F.sum("_start").over(Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_in", within).join(base, [*by, "_s"]).withColumn("record_no", F.col("_base") + F.col("_in")).drop("_s", "_start", "_in", "_base")


def assembled(lines: DataFrame, by: list[str], order: str, line: str, starts: Column, stretch: int = STRETCH) -> DataFrame:
    """(by, record_no, first, lines, record): the lines of each record joined by line ends, blank ones at its end left out."""
    rows = numbered(lines, by, order, starts, stretch)
    per = rows.groupBy(*by, "record_no").agg(F.min(order).alias("first"), F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct(order, line))).alias("_l"))
    return per.withColumn("record", F.regexp_replace(F.array_join(F.transform("_l", lambda x: x[line]), "\n"), r"\s+$", "")).drop("_l")


@dataclass(frozen=True)
class RecordFormat:
    """start: the first line of a record. part: what its other lines look like, for the share that must fit. fields: (time, level, source, message) of a record; time in a shape of timeparse, or milliseconds."""

    name: str
    start: str
    part: str
    time: str
    level: str
    source: str
    message: str
    cap: float = 1.0

    def starts(self, line: Column) -> Column:
        return line.rlike(self.start)

    def score(self, record: Column) -> Column:
        """1 if the record begins as it should and at least half of its lines fit, capped for formats that words alone tell."""
        fits = parsing.multiline_score(record, lambda x: x.rlike(self.start) | x.rlike(self.part))
        return parsing.capped_score(F.when(record.rlike(r"(?m)\A(?:" + self.start + ")"), fits).otherwise(0.0), self.cap)

    def parsed(self, record: Column) -> Column:
        part = lambda p: F.regexp_extract(record, p, 1) if p else F.lit("")
        return F.struct(part(self.time).alias("ts_text"), part(self.level).alias("level"), part(self.source).alias("source"), F.trim(part(self.message)).alias("message"))


#: Formats whose records have several lines. A later one wins no tie.
FORMATS = {
    f.name: f
    for f in (
        RecordFormat("logcat_long", r"^\[ \d\d-\d\d \d\d:\d\d:\d\d\.\d{3}\s+\d+:\s*\d+ [VDIWEF]/[^\]]*\]$", r"^\s*\S", r"^\[ (\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})", r"^\[ \S+ \S+\s+\d+:\s*\d+ ([VDIWEF])/", r"^\[ \S+ \S+\s+\d+:\s*\d+ [VDIWEF]/(\S*)\s*\]", r"(?s)\]\n(.*)$"),
        RecordFormat("slow_query", r"^# Time: \S+", r"^# (?:User@Host|Query_time|Schema)|^SET timestamp|;\s*$", r"^# Time: (\S+)", "", r"(?m)^# User@Host: (\S+?)\[", r"(?s)\A(?:#[^\n]*\n|SET timestamp[^\n]*\n)+(.*;)\s*$"),
        RecordFormat("journal_export", r"^__CURSOR=", r"^[A-Z_][A-Z0-9_]*=", r"(?m)^__REALTIME_TIMESTAMP=(\d+)", r"(?m)^PRIORITY=(\d)", r"(?m)^SYSLOG_IDENTIFIER=(.*)$", r"(?m)^MESSAGE=(.*)$"),
        RecordFormat("commit_log", r"^commit [0-9a-f]{40}\b", r"^(?:Author|Date|Merge):|^\s{4}", r"(?m)^Date:\s+(.*)$", "", r"(?m)^Author:\s*([^<\n]*?)\s*<", r"(?m)^ {4}(.*)$"),
        RecordFormat("python_trace", r"^\d{4}-\d\d-\d\d \S+ (?:ERROR|CRITICAL) ", r"^Traceback |^\s+File \"|^\s{4}|^[A-Za-z_.]+(?:Error|Exception)\b", r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\S*)", r"^\S+ \S+ (ERROR|CRITICAL) ", r"^\S+ \S+ [A-Z]+ ([\w.]+)", r"(?s).*\n([A-Za-z_.]+(?:Error|Exception)\b[^\n]*)$", 0.85),
    )
}
_LEVELS = {"V": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "CRITICAL": "FATAL", "ERROR": "ERROR", "0": "FATAL", "1": "FATAL", "2": "FATAL", "3": "ERROR", "4": "WARN", "5": "INFO", "6": "INFO", "7": "DEBUG"}


def detected(lines: DataFrame, by: list[str], order: str, line: str, formats: dict[str, RecordFormat] | None = None) -> DataFrame:
    """(by, format, score): of the lines whose number is less than SAMPLE_LINES above their file's first, cut into records by each format, the mean score; the best format above 0, an earlier one of equals."""
    known = list((formats or FORMATS).values())
    begins = lines.groupBy(*by).agg((F.min(order) + SAMPLE_LINES).alias("_until"))
    head = lines.join(begins, by).filter(F.col(order) < F.col("_until")).drop("_until")
    found = None
    for i, f in enumerate(known):
        records = assembled(head, by, order, line, f.starts(F.col(line))).filter((F.col("record_no") > 0) & (F.col("record_no") <= SAMPLE_RECORDS))
        one = records.groupBy(*by).agg(F.avg(f.score(F.col("record"))).alias("score")).withColumn("priority", F.lit(i)).withColumn("format", F.lit(f.name))
        found = one if found is None else found.unionByName(one)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "priority"))
    return found.filter(F.col("score") > 0).withColumn("_r", best).filter(F.col("_r") == 1).select(*by, "format", F.round("score", 6).alias("score"))


def parsed(lines: DataFrame, found: DataFrame, by: list[str], order: str, line: str, formats: dict[str, RecordFormat] | None = None, stretch: int = STRETCH) -> DataFrame:
    """(by, format, record_no, first, lines, ts_text, level, source, message, record) of all records of files whose format was found. All formats in one pass: a line starts a record if its file's format says so."""
    known = formats or FORMATS
    marked = lines.join(found.select(*by, "format"), by)
    starts, fields = F.lit(False), F.lit(None).cast("struct<ts_text:string,level:string,source:string,message:string>")
    for name, f in known.items():
        starts = F.when(F.col("format") == name, f.starts(F.col(line))).otherwise(starts)
        fields = F.when(F.col("format") == name, f.parsed(F.col("record"))).otherwise(fields)
    rows = assembled(marked, [*by, "format"], order, line, starts, stretch).filter(F.col("record_no") > 0).withColumn("_f", fields)
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _LEVELS.items() for x in p]), F.nullif(F.col("_f.level"), F.lit(""))), F.when(F.col("format") == "python_trace", "ERROR").otherwise("INFO"))
    return rows.select(*by, "format", "record_no", "first", "lines", F.col("_f.ts_text").alias("ts_text"), level.alias("level"), F.col("_f.source").alias("source"), F.col("_f.message").alias("message"), "record")


def times(records: DataFrame, reference: str = "2024-01-01 00:00:00") -> DataFrame:
    """Records + ts_ms: microseconds of journals, stamps without a year by the reference, and the usual shapes."""
    c = F.col("ts_text")
    at = F.when(F.col("format") == "journal_export", c.try_cast("double") / 1000.0).when(F.col("format") == "logcat_long", timeparse.logcat_ms(c, reference)).otherwise(timeparse.coerce_timestamp(c, "UTC", reference))
    return records.withColumn("ts_ms", at)
