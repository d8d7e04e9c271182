"""Text sources: sensors' outputs, key:value reports, write targets, projects, and what a scan knows about its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of languages, and folders that a project scan leaves out.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "dotnet", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "swift": "swift", "scala": "scala", "ex": "elixir", "lua": "lua", "sh": "shell"}
SKIPPED = r"/(\.git|node_modules|__pycache__|venv|\.venv|dist|build|target)/"


def sources(explicit: DataFrame, legacy: DataFrame) -> DataFrame:
    """The ordered union of two tables (priority, path, label, adapter), each path once, explicit ones first."""
    both = explicit.withColumn("_tier", F.lit(0)).unionByName(legacy.withColumn("_tier", F.lit(1)), allowMissingColumns=True)
    path = F.regexp_replace(F.regexp_replace("path", r"/\./", "/"), r"/+", "/")
    w = Window.partitionBy("path").orderBy("_tier", "priority")
    return both.withColumn("path", path).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r").orderBy("_tier", "priority").drop("_tier")


def files(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = 2_000_000) -> DataFrame:
    """(path, length, modified, language) of a tree's files up to a size, common build folders left out. Contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.try_element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), suffix)
    return listing.filter((F.col("length") <= max_bytes) & ~F.col("path").rlike(SKIPPED)).withColumn("language", language)


def census(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


#: Names under which systems and servers keep logs without a suffix that says so.
LOG_NAMES = "syslog messages dmesg kern boot secure maillog cron daemon auth faillog btmp wtmp lastlog catalina nohup access_log error_log console stdout stderr actions events journal debug trace".split()


def log_candidates(listing: DataFrame) -> DataFrame:
    """Files that look like logs: by suffix, by folder, by a conventional name, or .txt files named like one."""
    p = F.lower("path")
    named = p.rlike(r"/(?:" + "|".join(LOG_NAMES) + r")(?:[-_.]\d[\w-]*)?(?:\.(?:out|txt|\d+))?$")
    return listing.filter(named | p.rlike(r"\.(log|jsonl|ndjson|out|err)(\.\d+)?$") | p.rlike(r"/logs?/[^/]+$") | p.rlike(r"/[^/]*log[^/]*\.txt$"))


def file_status(lines: DataFrame, path: str, ts: str, now_ms: float, stale_ms: float = 120_000) -> DataFrame:
    out = lines.groupBy(path).agg(F.count("*").alias("lines"), F.max(ts).alias("last_ms"))
    return out.withColumn("stale", F.coalesce(F.lit(now_ms) - F.col("last_ms") > stale_ms, F.lit(True)))


def key_values(text: Column) -> Column:
    """All 'key: value' lines of a report as a map: keys in lower case with _ for spaces, borders of boxes taken off, the last of a repeated key kept."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s|│║*+\-]+|[\s|│║*+]+$", ""))
    pairs = F.filter(F.transform(lines, lambda x: F.struct(F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, r"^([A-Za-z][\w ./%-]*?)\s*:\s*(.+)$", 1))), r"\s+", "_").alias("k"), F.trim(F.regexp_extract(x, r"^([A-Za-z][\w ./%-]*?)\s*:\s*(.+)$", 2)).alias("v"))), lambda p: p["k"] != "")
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def ini_fields(text: Column) -> Column:
    """key = value lines of an INI text as an array of (key, value)."""
    k, v = (F.regexp_extract_all(text, F.lit(r"(?m)^\s*([\w.\-]+)\s*=\s*(.*?)\s*$"), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(k.alias("key"), v.alias("value"))


def latest_report(files: DataFrame, by: list[str], aliases: dict[str, str] | None = None, name: str = r"stats_[^/]*\.log$") -> DataFrame:
    """(by, path, values): of the files (by, path, modified, text) whose path fits, each key's newest one, and its 'key: value' lines with keys renamed by the aliases; a key that has its new name already wins over an alias of it."""
    newest = files.filter(F.col("path").rlike(name)).groupBy(*by).agg(F.max_by(F.struct("path", "text"), F.struct("modified", "path")).alias("_f"))
    values = key_values(F.col("_f.text"))
    pairs = F.create_map(*[F.lit(x) for p in (aliases or {}).items() for x in p]) if aliases else F.create_map().cast("map<string,string>")
    own = F.map_filter(values, lambda k, v: F.try_element_at(pairs, k).isNull())
    renamed = F.filter(F.transform(F.map_entries(F.map_filter(values, lambda k, v: F.try_element_at(pairs, k).isNotNull())), lambda e: F.struct(F.try_element_at(pairs, e["key"]).alias("key"), e["value"].alias("value"))), lambda e: ~F.map_contains_key(own, e["key"]))
    out = F.aggregate(renamed, own, lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, F.create_map(e["key"], e["value"]))))
    return newest.select(*by, F.col("_f.path").alias("path"), out.alias("values"))


def hottest_card(samples: DataFrame, by: list[str]) -> DataFrame:
    """The sample of each key's hottest card, of equals the lower number; cards without a temperature count as coldest."""
    rest = [c for c in samples.columns if c not in by]
    return samples.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("temp", F.lit(float("-inf"))), -F.col("gpu"))).alias("_s")).select(*by, "_s.*")


def gpu_csv(lines: DataFrame, line: str, keep: list[str] | None = None) -> DataFrame:
    """Samples, after the columns to keep, from 'index, name, temperature, utilisation, power' lines; [N/A] is null."""
    part = lambda i: F.nullif(F.trim(F.try_element_at(F.split(line, ","), F.lit(i))), F.lit("[N/A]"))
    return lines.select(*(keep or []), part(1).try_cast("int").alias("gpu"), part(2).alias("name"), part(3).try_cast("double").alias("temp"), F.regexp_replace(part(4), "[^0-9.]", "").try_cast("double").alias("load"), F.regexp_replace(part(5), "[^0-9.]", "").try_cast("double").alias("watts")).filter(F.col("gpu").isNotNull())


def thermal_report(text: Column) -> Column:
    """Limits of a power tool's thermal report as a map of numbers."""
    k, v = (F.regexp_extract_all(text, F.lit(r"(CPU_Speed_Limit|CPU_Scheduler_Limit|CPU_Available_CPUs)\s*=\s*(\d+)"), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(F.array_distinct(k), F.transform(F.slice(v, 1, F.size(F.array_distinct(k))), lambda x: x.cast("double")))


def hwmon(tree: DataFrame, path: str, value: str) -> DataFrame:
    """(sensor, kind, value) of sysfs readings: millidegrees, millivolts and microwatts scaled, fans as they are."""
    name = F.regexp_extract(path, r"([^/]+)/(temp|fan|in|power)(\d+)_(?:input|average)$", 2)
    scale = F.when(name == "temp", 1000.0).when(name == "in", 1000.0).when(name == "power", 1e6).otherwise(1.0)
    kind = F.when(name == "in", "volt").otherwise(name)
    sensor = F.regexp_extract(path, r"([^/]+)/((?:temp|fan|in|power)\d+)_(?:input|average)$", 1)
    return tree.filter(name != "").select(F.concat_ws("/", sensor, F.regexp_extract(path, r"((?:temp|fan|in|power)\d+)_", 1)).alias("sensor"), kind.alias("kind"), (F.trim(value).try_cast("double") / scale).alias("value"))


def write_targets(lsof: DataFrame, line: str) -> DataFrame:
    """(pid, path) of regular files open for writing, from captured lsof lines."""
    p = r"^\S+\s+(\d+)\s+\S+\s+\d+[wu]\S*\s+REG\s+\S+\s+\S+\s+\S+\s+(/.*)$"
    return lsof.filter(F.col(line).rlike(p)).select(F.regexp_extract(line, p, 1).cast("int").alias("pid"), F.regexp_extract(line, p, 2).alias("path"))


def test_summary(output: Column) -> Column:
    """(passed, failed, skipped, errors) of a test runner's last summary line."""
    n = lambda word: F.coalesce(F.regexp_extract(output, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0)).alias(word)
    return F.struct(n("passed"), n("failed"), n("skipped"), n("error"))


def import_edges(code: DataFrame, path: str, text: str) -> DataFrame:
    """(path, module): Python modules that each file imports."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"), F.lit(0))
    module = F.regexp_extract(F.col("x"), r"(?:from|import)\s+([\w.]+)", 1)
    return code.select(F.col(path).alias("path"), F.explode(found).alias("x")).select("path", module.alias("module")).distinct()


def symbols(code: DataFrame, path: str, text: str) -> DataFrame:
    """(path, kind, name) of classes and functions, by the common keywords of many languages."""
    pattern = r"(?m)^\s*(?:export\s+|public\s+|private\s+|async\s+|static\s+)*(class|def|func|fn|function|interface|struct)\s+([A-Za-z_]\w*)"
    kind, name = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return code.select(F.col(path).alias("path"), F.explode(F.arrays_zip(kind.alias("kind"), name.alias("name"))).alias("s")).select("path", "s.kind", "s.name")


def light_digest(code: DataFrame, path: str, text: str, most: int = 20) -> DataFrame:
    """(path, line): one line a file that names its first symbols."""
    pattern = r"(?m)^\s*(?:export\s+|public\s+|private\s+|async\s+|static\s+)*(class|def|func|fn|function|interface|struct)\s+([A-Za-z_]\w*)"
    kind, name = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    listed = F.slice(F.zip_with(kind, name, lambda k, n: F.concat(k, F.lit(" "), n)), 1, most)
    return code.select(F.col(path).alias("path"), F.concat(F.col(path), F.lit(": "), F.array_join(listed, ", ")).alias("line"))


# Files that name a project's language whatever else it holds, and files that hint at one.
STRONG_MARKERS = {"Cargo.toml": "rust", "go.mod": "go", "pom.xml": "java", "build.gradle": "java", "Gemfile": "ruby", "composer.json": "php", "pyproject.toml": "python", "setup.py": "python", "CMakeLists.txt": "cpp", "mix.exs": "elixir"}
WEAK_MARKERS = {"package.json": "javascript", "requirements.txt": "python", "Makefile": "c"}


def project_language(listing: DataFrame) -> DataFrame:
    """One row (language, why): by a strong marker file, else the language with most files, else a weak marker."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    of = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), name)
    marked = listing.select(F.lit(0).alias("tier"), of(STRONG_MARKERS).alias("language"), F.lit("strong marker").alias("why"), F.lit(1).cast("long").alias("n"))
    weak = listing.select(F.lit(2).alias("tier"), of(WEAK_MARKERS).alias("language"), F.lit("weak marker").alias("why"), F.lit(1).cast("long").alias("n"))
    counted = census(listing).select(F.lit(1).alias("tier"), "language", F.lit("census").alias("why"), F.col("files").alias("n"))
    found = marked.unionByName(counted).unionByName(weak).filter(F.col("language").isNotNull())
    return found.groupBy("tier", "language", "why").agg(F.sum("n").alias("n")).orderBy("tier", F.desc("n"), "language").limit(1).select("language", "why")


def last_lines(lines: DataFrame, by: list[str], order: str, n: int = 40) -> DataFrame:
    """The last n lines of each file, in order."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def last_records(lines: DataFrame, by: list[str], order: str, line: str, n: int = 20) -> DataFrame:
    """The last n JSON records of each file; lines that are none are left out and do not count."""
    return last_lines(lines.filter(F.try_parse_json(line).isNotNull() & F.col(line).rlike(r"^\s*\{")), by, order, n)


def raw_delta(lines: DataFrame, saved: DataFrame, path: str, offset: str, size: str, modified_ms: str, now_ms: float, most: int = 262_144, stale_ms: float = 120_000) -> DataFrame:
    """Lines beyond each file's saved offset (path, saved), with restarted and stale; a file that shrank below it starts again at 0, and the newest `most` bytes of what is new win."""
    joined = lines.join(saved.select(F.col(path), F.col("saved").alias("_saved")), path, "left").withColumn("restarted", F.coalesce(F.col("_saved") > F.col(size), F.lit(False)))
    since = F.when(F.col("restarted"), F.lit(0)).otherwise(F.coalesce("_saved", F.lit(0)))
    fresh = joined.filter((F.col(offset) >= since) & (F.col(offset) >= F.col(size) - most))
    return fresh.withColumn("stale", F.lit(now_ms) - F.col(modified_ms) > stale_ms).drop("_saved")


def action_log(profile: DataFrame) -> DataFrame:
    """One row a profile: the legacy field, else the sink named events, else the first .jsonl source. profile: name, priority, kind (legacy, sink or source), label, path."""
    rank = F.when((F.col("kind") == "legacy") & (F.col("path") != ""), 0).when((F.col("kind") == "sink") & (F.col("label") == "events"), 1).when((F.col("kind") == "source") & F.col("path").endswith(".jsonl"), 2)
    return profile.withColumn("_r", rank).filter(F.col("_r").isNotNull()).groupBy("name").agg(F.min_by("path", F.struct("_r", "priority")).alias("path"))
