"""Exceptions in multi-line blocks, of nine languages: assembled by window, read by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import records

#: Cues in the order in which they decide, and each language's frame pattern with (file, line, function) groups.
CUES = [("python", r"Traceback \(most recent call last\)|^\s*File \"[^\"]+\", line \d+"), ("go", r"(?m)^panic: |^goroutine \d+"), ("rust", r"panicked at"), ("php", r"PHP Fatal error|Uncaught .* in .*\.php"), ("cpp", r"terminate called|SIGSEGV|SIGABRT|Segmentation fault"), ("java", r"(?m)^\s+at [\w.$]+\([\w]+\.(?:java|kt|scala):\d+\)|Exception in thread"), ("ruby", r"\.rb:\d+:in "), ("dotnet", r"(?m)^\s+at .+ in .+:line \d+|--->"), ("node", r"(?m)^\s+at .+\(?[^()\s]+:\d+:\d+\)?")]
FRAMES = {
    "python": (r"File \"([^\"]+)\", line (\d+)(?:, in (\S+))?", (1, 2, 3)),
    "go": (r"(?m)^(\S+\([^)]*\))\s*\n\s+(\S+\.go):(\d+)", (2, 3, 1)),
    # the panic's own place first, in both spellings; then the backtrace, which names a function above each place
    "rust": (r"(?m)(?:panicked at (?:'[^']*', )?|^\s*\d+: +(\S+)\s*\n\s+at |^\s+at )([\w./\\-]+\.rs):(\d+)", (2, 3, 1)),
    "php": (r"#\d+ (\S+\.php)\((\d+)\): ([\w\\:>-]+)", (1, 2, 3)),
    "cpp": (r"#\d+\s+(?:0x[0-9a-f]+ in )?(\w[\w:~<>]*)[^\n]* at ([\w./-]+):(\d+)", (2, 3, 1)),
    "java": (r"at ([\w.$<>]+)\(([\w]+\.\w+):(\d+)\)", (2, 3, 1)),
    "ruby": (r"([\w./-]+\.rb):(\d+):in [`']([^'`]+)'", (1, 2, 3)),
    "dotnet": (r"at ([^\n(]+)\([^)]*\) in ([^\n:]+(?::\\[^\n:]+)?):line (\d+)", (2, 3, 1)),
    "node": (r"at (?:(\S+) \()?([^()\s]+):(\d+):\d+\)?", (2, 3, 1)),
}
MAX_FRAMES, MAX_MESSAGE = 25, 400


def blocks(lines: DataFrame, by: list[str], order: str, line: str, starts: Column) -> DataFrame:
    """(by, block_no, first, block): a line that starts a record opens a block, the others join the one before."""
    return records.assembled(lines, by, order, line, starts).select(*by, F.col("record_no").alias("block_no"), "first", F.col("record").alias("block"))


def language(block: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, cue in CUES:
        out = out.when(block.rlike(cue), F.lit(name))
    return out


def _first(block: Column, *patterns: str) -> tuple[Column, Column]:
    """(type, message) of the first pattern with these two groups that fits."""
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(patterns):
        hit = block.rlike(p)
        kind, message = F.when(hit, F.regexp_extract(block, p, 1)).otherwise(kind), F.when(hit, F.regexp_extract(block, p, 2)).otherwise(message)
    return kind, message


def _heads(block: Column) -> dict[str, tuple[Column, Column]]:
    name = r"[A-Za-z_][\w.$]*"
    last_cause = r"(?s).*Caused by: (?:[\w$]+\.)*([\w$]+)(?:: ([^\n]*))?"
    go = _first(block, r"(?m)^panic: ()([^\n]*)")
    rust = _first(block, r"panicked at ()[^\n']+\.rs:\d+(?::\d+)?:\n([^\n]*)", r"panicked at ()'([^']*)'", r"panicked at ()([^\n]*)")
    cpp_type, _ = _first(block, r"instance of '([^']+)'()", r"(SIGSEGV|SIGABRT)()", r"(Segmentation fault)()")
    return {
        "python": _first(block, rf"(?s).*\n({name})(?:: ([^\n]*(?:\n\s*\S[^\n]*)*))?\s*$", rf"^({name}): ([^\n]*)"),
        "node": _first(block, rf"(?m)^(?:Uncaught )?({name}(?:Error|Exception)?)(?: \[\w+\])?: ([^\n]*)"),
        "java": _first(block, last_cause, r"(?:Exception in thread \"[^\"]*\" )?(?:[\w$]+\.)*([\w$]+(?:Exception|Error|Throwable))(?:: ([^\n]*))?"),
        "go": (F.lit("panic"), go[1]),
        "ruby": (_first(block, r"\(([\w:]+)\)()")[0], _first(block, r"^()(?:[^\n]*?:\d+:in [`'][^'`]+'[:,]? ?)?([^\n(]*)")[1]),
        "dotnet": _first(block, r"(?s).*---> (?:[\w]+\.)*([\w]+): ([^\n]*)", r"(?:Unhandled exception\. )?(?:[\w]+\.)*([\w]+Exception): ([^\n]*)"),
        "rust": (F.lit("panic"), rust[1]),
        "php": _first(block, r"Uncaught (?:[\w\\]+\\)?(\w+): (.*?) in \S+:\d+", r"PHP (Fatal error):\s+([^\n]*)"),
        "cpp": (cpp_type, _first(block, r"what\(\):\s+()([^\n]*)")[1]),
    }


def frames(block: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    file, line, func = (F.regexp_extract_all(block, F.lit(pattern), F.lit(g)) for g in groups)
    zipped = F.arrays_zip(file.alias("file"), line.alias("line"), func.alias("func"))
    return F.slice(F.transform(zipped, lambda f: F.struct(f["file"].alias("file"), f["line"].try_cast("int").alias("line"), f["func"].alias("func"))), 1, MAX_FRAMES)


def parse_exceptions(rows: DataFrame, block: str) -> DataFrame:
    """rows + language, type, message, frames, fingerprint and cause of the exception in each block; nulls where there is none."""
    b = F.col(block)
    heads = _heads(b)
    rows = rows.withColumn("language", language(b))
    pick = lambda part: F.coalesce(*[F.when(F.col("language") == k, part(k)) for k in heads])
    out = rows.withColumn("type", pick(lambda k: heads[k][0])).withColumn("message", F.substring(F.trim(pick(lambda k: heads[k][1])), 1, MAX_MESSAGE))
    out = out.withColumn("frames", pick(lambda k: frames(b, *FRAMES[k])))
    label = F.concat_ws(": ", "type", "message")
    return out.withColumn("fingerprint", F.when(F.col("language").isNotNull(), text.fingerprint(label))).withColumn("cause", text.probable_cause(F.col("type"), F.col("message")))


def _parts(path: Column) -> Column:
    """A path's parts from the last to the first."""
    return F.reverse(F.filter(F.split(path, r"[/\\\\]+"), lambda x: (x != "") & (x != ".")))


def _endings(parts: Column) -> Column:
    """All endings of a path, each as one text, from its name alone to the whole."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("length"), F.array_join(F.slice(parts, 1, n), "/").alias("ending")))


def resolved_files(errors: DataFrame, code: DataFrame, file: str = "file", path: str = "path") -> DataFrame:
    """(file, path, length, candidates): for each distinct file of a frame the path with which it shares the longest ending, where one of the two is an ending of the other.

    Every path gives its endings once, counted before they meet the files, so any number of paths of one name are one row. Of equally long matches the
    first path by name is taken, and candidates says how many there were. The joins are merges, as Spark takes rows made by explode() for as few as their
    source and would send them through the driver.
    """
    files = errors.select(F.col(file).alias("file")).filter(F.col("file").isNotNull()).distinct().withColumn("_f", _parts(F.col("file"))).filter(F.size("_f") > 0)
    paths = code.select(F.col(path).alias("path")).filter(F.col("path").isNotNull()).distinct().withColumn("_p", _parts(F.col("path"))).filter(F.size("_p") > 0)
    ends = paths.select("path", F.explode(_endings(F.col("_p"))).alias("e")).groupBy(F.col("e.ending").alias("ending")).agg(F.min("path").alias("path"), F.count("*").alias("candidates"))
    inside = files.select("file", F.size("_f").alias("length"), F.array_join("_f", "/").alias("ending")).join(ends.hint("merge"), "ending").select("file", "path", "length", "candidates")
    whole = paths.groupBy(F.array_join("_p", "/").alias("ending")).agg(F.min("path").alias("path"), F.count("*").alias("candidates"))
    around = files.select("file", F.explode(_endings(F.col("_f"))).alias("e")).select("file", "e.length", "e.ending").join(whole.hint("merge"), "ending").select("file", "path", "length", "candidates")
    best = inside.unionByName(around).groupBy("file").agg(F.min(F.struct((-F.col("length")).alias("less"), "path", "candidates")).alias("b"))
    return best.select("file", "b.path", (-F.col("b.less")).alias("length"), "b.candidates")


def source_lines(errors: DataFrame, code: DataFrame, context: int = 4) -> DataFrame:
    """Each error frame (file, line) with the lines around it of code (path, line_no, text), by the path that shares the longest ending with the frame's file."""
    found = errors.join(resolved_files(errors, code).select(F.col("file").alias("_file"), F.col("path").alias("path")).hint("merge"), F.col("file") == F.col("_file")).drop("_file")
    near = found.withColumn("line_no", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)))
    text_of = code.select("path", F.col("line_no").alias("_no"), *[c for c in code.columns if c not in ("path", "line_no")])
    return near.join(text_of.hint("merge"), (near["path"] == text_of["path"]) & (F.col("line_no") == F.col("_no"))).drop(text_of["path"]).drop("_no")
