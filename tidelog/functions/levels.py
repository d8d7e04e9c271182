"""Levels, categories and severity that the message itself gives away, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level words of many log dialects, by the canonical level they mean.
LEVEL_WORDS = {
    "TRACE": "trace trc verbose vrb v",
    "DEBUG": "debug dbg dbug d fine finer finest",
    "INFO": "info inf information notice i",
    "WARN": "warn warning wrn w",
    "ERROR": "error err eror severe e",
    "FATAL": "fatal critical crit ftl panic emerg alert f c",
}
LEVEL_RANK = {"TRACE": 1, "DEBUG": 2, "INFO": 3, "WARN": 4, "ERROR": 5, "FATAL": 6}
LEVEL_CATEGORY = {"TRACE": "debug", "DEBUG": "debug", "INFO": "log", "WARN": "warn", "ERROR": "error", "FATAL": "error"}
CATEGORY_LEVEL = {"debug": "DEBUG", "log": "INFO", "info": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR", "fatal": "FATAL", "crash": "FATAL"}
SYSLOG_LEVEL = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}
PINO_LEVEL = {10: "TRACE", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
WEAK_LEVELS = ["", "INFO", "DEBUG", "TRACE", "NOTICE", "VERBOSE"]
# What tells of a failure, first match wins. Fields: (keys, values that fail, reason); a value list may be a test of the whole value.
FALSE_WORDS, TRUE_WORDS = ["false", "0", "no"], ["true", "1", "yes"]
FAILING_FIELDS = [
    (["ok"], FALSE_WORDS, "ok=false"),
    (["success", "succeeded", "successful"], FALSE_WORDS, "success=false"),
    (["failed", "failure", "fail"], TRUE_WORDS, "failed=true"),
    (["error"], ["true", "yes"], "error=true"),
    (["error", "errors", "failure", "failures", "failed", "dropped", "lost"], "count", "non-zero failure count"),
    (["status"], "http", "http 4xx/5xx"),
    (["rc", "exit", "exitcode", "exit_code", "returncode"], "code", "non-zero exit code"),
]
# Phrases of whole words, any white space between them.
FAILING_PHRASES = [
    (["failed to", "unable to"], "failed to ..."),
    (["timed out"], "timed out"),
    (["timeout exceeded", "timeout expired", "timeout after", "timeout waiting", "timeout reached"], "timeout exceeded"),
    (["refused", "unreachable"], "connection refused"),
]
_FIELD_KEYS = sorted({k for keys, _, _ in FAILING_FIELDS for k in keys})
_ANY_FIELD = r"(?iU)\b(" + "|".join(_FIELD_KEYS) + r")(?=\s*[:=]\s*(-?\w+))"


def lookup(table: dict, key: Column) -> Column:
    """A literal map's value or null; the table is a constant of the plan, so nothing is joined."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_level(token: Column) -> Column:
    """The canonical level of a word; an unknown word in upper case, null as the empty string."""
    words = {w: level for level, ws in LEVEL_WORDS.items() for w in ws.split()}
    trimmed = F.trim(F.coalesce(token, F.lit("")))
    return F.coalesce(lookup(words, F.lower(trimmed)), F.upper(trimmed))


def level_category(level: Column) -> Column:
    return F.coalesce(lookup(LEVEL_CATEGORY, F.upper(level)), F.lit("log"))


def category_level(category: Column) -> Column:
    return F.coalesce(lookup(CATEGORY_LEVEL, F.lower(category)), F.lit("INFO"))


def level_rank(level: Column) -> Column:
    """1 to 6, and 0 for levels without a rank."""
    return F.coalesce(lookup(LEVEL_RANK, F.upper(level)), F.lit(0))


def syslog_level(severity: Column) -> Column:
    return lookup(SYSLOG_LEVEL, severity.cast("int"))


def numeric_level(value: Column) -> Column:
    """Numbers of 10 and more are pino's scale, smaller ones syslog's."""
    number = value.cast("int")
    return F.when(number >= 10, lookup(PINO_LEVEL, number)).otherwise(lookup(SYSLOG_LEVEL, number))


def _field_rule(key: Column, value: Column) -> Column:
    """The number of the first rule that a field breaks, or null."""
    tests = {"count": value.rlike(r"(?U)^\d+$") & (value != "0"), "http": value.rlike(r"(?U)^[45]\d\d$"), "code": value.rlike(r"(?U)^-?\d+$") & (value != "0")}
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, (keys, fails, _) in enumerate(FAILING_FIELDS):
        out = out.when(key.isin(keys) & (tests[fails] if isinstance(fails, str) else value.isin(fails)), F.lit(i))
    return out


def content_reason(text: Column) -> Column:
    """Why the text reads as a failure, or null: first by its fields, of which all are read, then by its phrases."""
    keys, values = (F.regexp_extract_all(text, F.lit(_ANY_FIELD), F.lit(i)) for i in (1, 2))
    broken = F.array_min(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: _field_rule(F.lower(p["k"]), F.lower(p["v"]))))
    reasons = F.array(*[F.lit(reason) for _, _, reason in FAILING_FIELDS])
    # most lines name no such key and hold no such word, which one look tells
    out = F.when(text.rlike(_ANY_FIELD), F.get(reasons, broken))
    each = [(r"(?iU)\b(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + r")\b", reason) for phrases, reason in FAILING_PHRASES]
    said = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, reason in each:
        said = said.when(text.rlike(pattern), F.lit(reason))
    words = r"(?iU)\b(?:failed|unable|timed|timeout|refused|unreachable)\b"
    return F.coalesce(out, F.when(text.rlike(words), said))


def escalated(level: Column, text: Column) -> tuple[Column, Column, Column]:
    """(level, level_escalated_from, escalation_reason): a weak level rises to WARN where the content tells of a failure, and never further."""
    reason = F.when(F.coalesce(level, F.lit("")).isin(WEAK_LEVELS), content_reason(text))
    return F.when(reason.isNotNull(), F.lit("WARN")).otherwise(level), F.when(reason.isNotNull(), F.coalesce(level, F.lit(""))), reason
