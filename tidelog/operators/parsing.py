"""From text lines to unified events: detect each source's format, parse with that one, fall back, escalate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, levels, text, timeparse
from ..sources import tail
from . import lineage

#: Lines of a source on which its format is decided.
SAMPLE = 60
_PARTS = "struct<ts_text:string,ts_ms:double,level:string,source:string,message:string,data:map<string,string>,adapter:string>"
FALLBACK = ["structural", "generic_ts", "raw"]


def read_lines(spark: SparkSession, path: str, label: str | None = None, glob: str | None = None) -> DataFrame:
    """(log_path, log_label, line_no, line) of text files, large ones split between tasks; blank lines are counted and left out.

    A line's number is its place in its block of the file plus the lines of the blocks before, so no task sorts a file.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True) if glob else spark.read
    read = reader.text(path).select(F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    sizes = reader.text(path).groupBy(F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("block")).agg(F.count("*").alias("n"))
    before = sizes.select("log_path", "block", (F.sum("n").over(Window.partitionBy("log_path").orderBy("block")) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("log_path", "block").orderBy("_at"))
    lines = read.withColumn("_place", place).join(before, ["log_path", "block"])
    return lines.filter(F.trim("line") != "").select("log_path", F.lit(label or "").alias("log_label"), (F.col("_before") + F.col("_place") - 1).alias("line_no"), "line")


def multiline_score(element: Column, hit, threshold: float = 0.5, literal: bool = False) -> Column:
    """1 if `hit` (of a Column) holds for at least `threshold` of the lines of a multi-line element, else 0; literal: breaks may be spelt as backslash n."""
    lines = text.logical_lines(element) if literal else F.filter(F.split(element, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.when((F.size(lines) > 0) & (F.size(F.filter(lines, hit)) >= threshold * F.size(lines)), 1.0).otherwise(0.0)


def capped_score(share: Column, cap: float = 0.85) -> Column:
    """The score of a format known by its words alone: below what a strict grammar reaches."""
    return F.least(F.lit(cap), share)


def numbered(lines: DataFrame, source: str, order: list[str]) -> DataFrame:
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order)))


def scores(sample: DataFrame, source: str, line: str, catalogue: dict[str, formats.Format] | None = None) -> DataFrame:
    """(source, adapter, priority, score): the share of a source's sample lines that each format fits, in one pass over the lines."""
    known = list((catalogue or formats.FORMATS).values())
    c = F.col(line)
    hits = [F.when(f.matches(c), 1.0).otherwise(0.0) for f in known]
    hits += [F.when(formats.is_json(c), 1.0).otherwise(0.0), F.when(timeparse.parse_timestamp(c).isNotNull(), formats.GENERIC_SHARE).otherwise(0.0), F.when(formats.recognised(c), formats.STRUCTURAL_CAP).otherwise(0.0), F.lit(formats.RAW_SCORE)]
    names = [f.name for f in known] + ["jsonl", "generic_ts", "structural", "raw"]
    out = sample.filter(F.trim(line) != "").select(F.col(source).alias("source"), F.posexplode(F.array(*hits)).alias("priority", "hit"))
    out = out.groupBy("source", "priority").agg(F.avg("hit").alias("score"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("priority") + 1)
    floor = F.when(F.col("priority") == len(names) - 2, F.greatest(F.col("score"), F.lit(formats.STRUCTURAL_FLOOR))).otherwise(F.col("score"))
    return out.select("source", name.alias("adapter"), "priority", floor.alias("score"))


def detect(lines: DataFrame, source: str, line: str, order: list[str], catalogue: dict[str, formats.Format] | None = None) -> DataFrame:
    """(source, adapter, score): the best format of each source's first lines; of equal ones the earlier in the catalogue.

    The first line is held against all formats. Where the earliest that fits it fits all other lines too, no other can be better or as good and earlier;
    only the remaining sources have all their lines held against all formats, and a row is made only for a format that fits.
    """
    known = list((catalogue or formats.FORMATS).values())
    c = F.col("_line")
    first = numbered(lines.filter(F.trim(line) != "").select(F.col(source).alias("source"), F.col(line).alias("_line"), *[F.col(x).alias(f"_o{i}") for i, x in enumerate(order)]), "source", [f"_o{i}" for i in range(len(order))]).filter(F.col("_n") <= SAMPLE).select("source", "_n", "_line")
    json, generic, structural = len(known), len(known) + 1, len(known) + 2
    name = F.element_at(F.array(*[F.lit(f.name) for f in known], *map(F.lit, ("jsonl", "generic_ts", "structural"))), F.col("priority") + 1)
    fit = lambda: F.concat(formats.fitting(c, known), F.when(formats.is_json(c), F.array(F.lit(json))).otherwise(F.array().cast("array<int>")))
    by = Window.partitionBy("source").orderBy("_n")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = first.withColumn("_fit", F.when(F.col("_n") == 1, fit())).withColumn("_lead", F.first(F.get("_fit", 0)).over(by))
    fits = F.when(F.col("_lead") == json, formats.is_json(c)).when(F.col("_n") == 1, F.col("_lead").isNotNull())
    for i, f in enumerate(known):
        fits = fits.when(F.col("_lead") == i, f.matches(c))
    lead = lead.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_all", F.bool_and("_fits").over(whole)).withColumn("_lines", F.count("*").over(whole))
    one = lambda priority, hit: F.struct(F.lit(priority).alias("priority"), hit.alias("hit"))
    named = F.transform(F.coalesce("_fit", fit()), lambda p: F.struct(p.alias("priority"), F.lit(1.0).alias("hit")))
    rest = F.array(one(generic, F.when(timeparse.parse_timestamp(c).isNotNull(), formats.GENERIC_SHARE).otherwise(0.0)), one(structural, F.when(formats.recognised(c), formats.STRUCTURAL_CAP).otherwise(0.0)))
    won = F.array(F.struct(F.col("_lead").alias("priority"), F.col("_lines").cast("double").alias("hit")))
    hits = lead.filter((F.col("_n") == 1) | ~F.col("_all")).select("source", "_lines", F.explode(F.when(F.col("_all"), won).otherwise(F.concat(named, rest))).alias("h"))
    found = hits.groupBy("source", "_lines", "h.priority").agg((F.sum("h.hit") / F.col("_lines")).alias("score"))
    floor = F.when(F.col("priority") == structural, F.greatest(F.col("score"), F.lit(formats.STRUCTURAL_FLOOR))).otherwise(F.col("score"))
    best = found.groupBy("source").agg(F.min(F.struct((-floor).alias("less"), "priority")).alias("b"))
    return best.select("source", "b.*").select("source", name.alias("adapter"), F.round(-F.col("less"), 6).alias("score"))


def _marked(lines: DataFrame, detected: DataFrame, source: str) -> tuple[list[str], DataFrame]:
    """The names of the formats in use, and the lines + _adapter, their source's format."""
    used = sorted(r["adapter"] for r in detected.select("adapter").distinct().collect())
    return used, lines.join(detected.select(F.col("source").alias("_of"), F.col("adapter").alias("_adapter")), F.col(source) == F.col("_of"), "left")


def parse(lines: DataFrame, detected: DataFrame, source: str, line: str, zone: str = "UTC", reference: str = "2024-01-01 00:00:00", catalogue: dict[str, formats.Format] | None = None) -> DataFrame:
    """Lines as events: ts_ms, level, category, source, message, data, adapter, trace_id, raw and the escalation audit, after all columns of the lines.

    Each line is read once, by its own source's format, and the plan holds no other formats than those in use; a line that
    does not fit is read by its structure, and no line is lost. The names of the formats in use come to the driver.
    """
    known = catalogue or formats.FORMATS
    used, marked = _marked(lines, detected, source)
    c = F.col(line)
    empty = F.lit(None).cast(_PARTS)
    one = None
    for name in used:
        if name == "jsonl" or name in known:
            this = formats.json_line(c) if name == "jsonl" else known[name].parsed(c)
            one = F.when(F.col("_adapter") == name, this) if one is None else one.when(F.col("_adapter") == name, this)
    rows = marked.withColumn("_one", empty if one is None else one).withColumn("_kv", F.when(F.col("_one").isNull(), formats.pairs(c)))
    rows = rows.withColumn("_e", F.coalesce(F.col("_one"), formats.structural(c, F.col("_kv"))))
    rows = rows.withColumn("_ms", F.coalesce(F.col("_e.ts_ms"), timeparse.coerce_timestamp(F.col("_e.ts_text"), zone, reference)))
    native = F.when(F.col("_adapter") == "jsonl", formats.native_category(c)) if "jsonl" in used else F.lit(None).cast("string")
    _, was, why = levels.escalated(F.col("_e.level"), F.when(F.coalesce(F.col("_e.message"), F.lit("")) == "", c).otherwise(F.col("_e.message")))
    level = F.when(why.isNotNull(), "WARN").when(F.col("_e.level") == "", "INFO").otherwise(F.col("_e.level"))
    return rows.select(
        *[F.col(x) for x in lines.columns],
        F.col("_ms").alias("ts_ms"),
        level.alias("level"),
        F.coalesce(native, levels.level_category(level)).alias("category"),
        F.col("_e.source").alias("event_source"),
        F.col("_e.message").alias("message"),
        F.col("_e.data").alias("data"),
        F.col("_e.adapter").alias("adapter"),
        text.trace_id(c).alias("trace_id"),
        c.alias("raw"),
        was.alias("level_escalated_from"),
        why.alias("escalation_reason"),
    )


def read_by(lines: DataFrame, detected: DataFrame, source: str, line: str, catalogue: dict[str, formats.Format] | None = None) -> DataFrame:
    """Lines + adapter as `parse` gives it: the format of the line's source where the line fits it, else structural. Nothing else is read from the lines."""
    known = catalogue or formats.FORMATS
    used, marked = _marked(lines, detected, source)
    fits = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in used:
        if name == "jsonl" or name in known:
            fits = fits.when((F.col("_adapter") == name) & (formats.is_json_line(F.col(line)) if name == "jsonl" else known[name].matches(F.col(line))), F.lit(name))
    return marked.select(*[F.col(x) for x in lines.columns], fits.otherwise("structural").alias("adapter"))


def normalised(lines: DataFrame, source: str, line: str, order: list[str], **options) -> DataFrame:
    """Detect and parse."""
    return parse(lines, lineage.cut(detect(lines, source, line, order)), source, line, **options)


def recognised(lines: DataFrame, source: str, line: str, order: list[str]) -> DataFrame:
    """Detect, and the adapter that reads each line."""
    return read_by(lines, lineage.cut(detect(lines, source, line, order)), source, line)


def tail_events(spark: SparkSession, path: str, label: str | None = None, adapter: str = "auto", tail_bytes: int = tail.TAIL_BYTES, max_offset: int | dict[str, int] = 0, glob: str = "*", **options) -> DataFrame:
    """The events in the last bytes of each file below max_offset, after log_path, log_label, offset, end and line. Each file's format is found on its first lines there, unless adapter names it; one name that is unknown is read as raw text, and adapter says what was used."""
    lines = tail.read_tail(spark, path, tail_bytes, max_offset, glob).filter(F.trim("line") != "").select(F.col("path").alias("log_path"), F.lit(label or "").alias("log_label"), "offset", "end", "line")
    known = detect(lines, "log_path", "line", ["offset"]) if adapter == "auto" else lines.select(F.col("log_path").alias("source"), F.lit(adapter if adapter in formats.FORMATS or adapter == "jsonl" else "raw").alias("adapter")).distinct()
    return parse(lines, known, "log_path", "line", **options)


def docker_json(lines: DataFrame, line: str) -> DataFrame:
    """Container logs {log, stream, time}: stderr is of category error."""
    d = F.from_json(F.col(line), "log string, stream string, time string")
    out = lines.withColumn("_d", d).filter(F.col("_d.log").isNotNull())
    level = F.when(F.col("_d.stream") == "stderr", "ERROR").otherwise("INFO")
    return out.select(*lines.columns, timeparse.parse_timestamp(F.col("_d.time")).alias("ts_ms"), level.alias("level"), levels.level_category(level).alias("category"), F.regexp_replace("_d.log", r"\r?\n$", "").alias("message"))


def coverage(parsed: DataFrame, source: str, declared: DataFrame | None = None) -> DataFrame:
    """Per source: lines, lines that only a fallback read, and whether its format is known. With a table of declared sources also the verdict: covered, gaps, or pending where a declared source has no line yet."""
    gap = F.col("adapter").isin(FALLBACK)
    found = parsed.groupBy(source).agg(F.count("*").alias("n"), F.count_if(gap).alias("gaps"), F.bool_and(~gap).alias("ready"))
    if declared is None:
        return found
    both = declared.select(source).distinct().join(found, source, "full_outer")
    verdict = F.when(F.col("n").isNull(), "pending").when(F.col("ready"), "covered").otherwise("gaps")
    return both.select(source, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("ready", F.lit(False)).alias("ready"), verdict.alias("verdict"))


def test_line(spark: SparkSession, line: str, top: int = 5) -> DataFrame:
    """The best formats of one line and their scores; `parse` with the first gives its event."""
    one = spark.createDataFrame([("line", line)], "source string, line string")
    return scores(one, "source", "line").filter(F.col("score") > 0).orderBy(F.desc("score"), "priority").limit(top).select("adapter", "score")


def test_event(spark: SparkSession, line: str, **options) -> DataFrame:
    """The event that a line gives with its best format, and that format's score."""
    one = spark.createDataFrame([("line", line)], "source string, line string")
    found = detect(one.withColumn("_at", F.lit(0)), "source", "line", ["_at"])
    return parse(one, found, "source", "line", **options).join(found.select("source", "score"), "source")


def add_format(catalogue: dict[str, formats.Format], name: str, pattern: str, sample: list[str], spark: SparkSession, rule: str = "", time: str = "stamp", family: str = "user") -> dict[str, formats.Format]:
    """The catalogue with one more format in front. Refused if the name is built in, the format does not win its own sample, or it takes a sample line that a named format reads."""
    if name in formats.FORMATS:
        raise ValueError(f"{name} is a built-in format")
    new = formats.Format(name, family, time, rule, pattern)
    lines = spark.createDataFrame([(s,) for s in sample], "line string")
    fit, taken = lines.agg(F.count_if(new.matches(F.col("line"))), F.count_if(reduce(lambda a, b: a | b, [f.matches(F.col("line")) for f in formats.FORMATS.values()]))).first()
    if fit < len(sample) or not sample:
        raise ValueError(f"{name} fits {fit} of {len(sample)} sample lines")
    if taken:
        raise ValueError(f"built-in formats read {taken} of the sample lines of {name}")
    return {name: new, **catalogue}


def save_format(spark: SparkSession, path: str, fmt: formats.Format) -> None:
    """Keep a format for later sessions; names that are built in or kept already are refused."""
    if fmt.name in formats.FORMATS or fmt.name in load_formats(spark, path):
        raise ValueError(f"there is a format {fmt.name} already")
    row = [(fmt.name, fmt.family, fmt.time, fmt.rule, fmt.pattern)]
    spark.createDataFrame(row, "name string, family string, time string, rule string, pattern string").coalesce(1).write.mode("append").json(path)


def load_formats(spark: SparkSession, path: str) -> dict[str, formats.Format]:
    """The kept formats by name; none where nothing has been kept."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {}
    rows = spark.read.schema("name string, family string, time string, rule string, pattern string").json(path).orderBy("name").collect()  # one row a format
    return {r["name"]: formats.Format(*r) for r in rows}


def format_table(spark: SparkSession, family: str = "", q: str = "") -> DataFrame:
    """The catalogue as rows, for listing, filtering by family or part of the name, and paging."""
    listed = [(i, f.name, f.family, f.time, f.pattern) for i, f in enumerate(formats.FORMATS.values()) if family in ("", f.family) and q in f.name]
    return spark.createDataFrame(listed, "priority int, name string, family string, time string, pattern string")
