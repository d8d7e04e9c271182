"""Timestamps in text, as Column expressions that give epoch milliseconds or null and never raise.

Stamps without a zone count in `zone`; stamps without a year or a date take them from `reference`, a timestamp string in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
_CLOCK = r"(\d{2}):(\d{2}):(\d{2})"
# The shapes, in the order in which they are tried at the start of a text.
ISO = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[ T]{_CLOCK}(?:[.,](\d{{1,9}}))?\s*(Z|[+-]\d{{2}}:?\d{{2}})?"
SLASH = rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_CLOCK}(?:\.(\d{{1,9}}))?"
CTIME = rf"^[A-Z][a-z]{{2}}\s+([A-Z][a-z]{{2}})\s+(\d{{1,2}})\s+{_CLOCK}(?:\.(\d{{1,9}}))?\s+(\d{{4}})"
CLF = rf"^(\d{{2}})/([A-Z][a-z]{{2}})/(\d{{4}})[: ]{_CLOCK}(?:\s*([+-]\d{{4}}))?"
BSD = rf"^([A-Z][a-z]{{2}})\s+(\d{{1,2}})\s+{_CLOCK}"
CLOCK = rf"^{_CLOCK}(?:[.,](\d{{1,9}}))?"


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _month(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in _MONTHS.items() for x in p]), name)


def parts_ms(year, month, day, hour, minute, second, fraction=None) -> Column:
    """Calendar parts as epoch milliseconds as if in UTC; null where they are no time. fraction: the digits after the point."""
    zero = F.lit(0)
    days = F.try_make_timestamp_ntz(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), zero, zero, zero.cast("decimal(16,6)")).cast("date")
    h, m, s = hour.try_cast("int"), minute.try_cast("int"), second.try_cast("int")
    valid = (h < 24) & (m < 60) & (s < 60)
    whole = F.datediff(days, F.lit("1970-01-01").cast("date")).cast("long") * 86400000 + (h * 3600 + m * 60 + s).cast("long") * 1000
    if fraction is not None:
        # microseconds, then cut: what stands beyond the sixth digit is dropped
        whole = whole + F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("double") / 1000, F.lit(0.0))
    return F.when(valid & days.isNotNull(), whole.cast("double"))


def offset_ms(offset: Column) -> Column:
    """Milliseconds of Z or +HH:MM or +HHMM; null where there is none."""
    digits = F.regexp_replace(offset, "[^0-9]", "")
    value = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))) * 60000
    return F.when(F.upper(offset) == "Z", F.lit(0)).when(offset.startswith("-"), -value).when(offset.startswith("+"), value)


def local_ms(as_utc: Column, zone: str) -> Column:
    """A wall clock of a zone, given as if it were UTC."""
    if zone.upper() in ("UTC", "Z", "GMT"):
        return as_utc
    stamp = F.timestamp_millis(F.floor(as_utc).cast("long"))
    return F.unix_millis(F.to_utc_timestamp(stamp, zone)).cast("double") + (as_utc - F.floor(as_utc))


def parse_timestamp(text: Column, zone: str = "UTC", reference: str = "2024-01-01 00:00:00") -> Column:
    """Epoch milliseconds of the stamp a text starts with. The first shape that matches decides, even where its values are no time."""
    t = F.trim(text)
    today = F.lit(reference).cast("timestamp_ntz")
    g = lambda p: lambda i: _part(t, p, i)
    i, s, c, f, b, w = g(ISO), g(SLASH), g(CTIME), g(CLF), g(BSD), g(CLOCK)
    # in these two shapes all up to the second stands at fixed places
    fixed = [F.substring(t, at, n) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    iso = parts_ms(*fixed, i(7))
    slash = parts_ms(*fixed, s(7))
    ctime = parts_ms(c(7), _month(c(1)), c(2), c(3), c(4), c(5), c(6))
    clf = parts_ms(f(3), _month(f(2)), f(1), f(4), f(5), f(6))
    bsd = parts_ms(F.year(today), _month(b(1)), b(2), b(3), b(4), b(5))
    clock = parts_ms(F.year(today), F.month(today), F.day(today), w(1), w(2), w(3), w(4))
    return (
        F.when(t.rlike(ISO), F.when(i(8) == "", local_ms(iso, zone)).otherwise(iso - offset_ms(i(8))))
        .when(t.rlike(SLASH), local_ms(slash, zone))
        .when(t.rlike(CTIME), local_ms(ctime, zone))
        .when(t.rlike(CLF), clf - F.coalesce(offset_ms(F.nullif(f(7), F.lit(""))), F.lit(0)))
        .when(t.rlike(BSD), local_ms(bsd, zone))
        .when(t.rlike(CLOCK), local_ms(clock, zone))
    )


def epoch_ms(value: Column) -> Column:
    """A number as epoch milliseconds, by its size: ns, us, ms or s; null where it is none of these."""
    v = value.try_cast("double")
    return F.when(v > 1e17, v / 1e6).when(v > 1e14, v / 1e3).when(v > 1e11, v).when(v > 1e8, v * 1000.0)


def coerce_timestamp(value: Column, zone: str = "UTC", reference: str = "2024-01-01 00:00:00") -> Column:
    """Epoch milliseconds of a JSON value given as text: a number by size, else a stamp."""
    numeric = F.trim(value).rlike(r"^-?\d+(\.\d+)?$")
    return F.when(numeric, epoch_ms(F.trim(value))).otherwise(parse_timestamp(value, zone, reference))


def ms_to_iso(ms: Column) -> Column:
    """ISO 8601 with milliseconds and Z; empty for null."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(F.timestamp_millis(F.floor(ms).cast("long")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def iso_to_ms(text: Column) -> Column:
    return F.when(F.trim(text).rlike(ISO), parse_timestamp(text))


def ntz_ms(stamp: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, as UTC, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp.cast("timestamp_ntz"))


def two_digit_year(year: Column) -> Column:
    """Years below 70 are of this century."""
    y = year.try_cast("int")
    return F.when(y < 70, y + 2000).otherwise(y + 1900)


def compact_ms(text: Column) -> Column:
    """YYYYMMDD[HHMM[SS]][+ZZZZ]."""
    p = r"^(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?(?:\.\d+)?([+-]\d{4})?$"
    t = F.trim(text)
    g = lambda i: F.when(_part(t, p, i) == "", F.lit("0")).otherwise(_part(t, p, i))
    return F.when(t.rlike(p), parts_ms(g(1), g(2), g(3), g(4), g(5), g(6)) - F.coalesce(offset_ms(F.nullif(_part(t, p, 7), F.lit(""))), F.lit(0)))


def us_date_ms(date: Column, time: Column) -> Column:
    """M/D/YYYY (or two digits) with H:MM[:SS] and AM or PM, if any."""
    d, t = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AP]M)?$"
    year = F.when(F.length(_part(date, d, 3)) == 2, two_digit_year(_part(date, d, 3))).otherwise(_part(date, d, 3).try_cast("int"))
    hour = _part(time, t, 1).try_cast("int")
    half = F.upper(_part(time, t, 4))
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), F.lit(0)).otherwise(hour)
    second = F.when(_part(time, t, 3) == "", F.lit("0")).otherwise(_part(time, t, 3))
    return F.when(date.rlike(d) & time.rlike(t), parts_ms(year, _part(date, d, 1), _part(date, d, 2), hour, _part(time, t, 2), second))


def sane_ms(ms: Column, low: float = 0.0, high: float = 4102444800000.0) -> Column:
    """Null outside the range (by default 1970 to 2100)."""
    return F.when((ms > low) & (ms < high), ms)


def logcat_ms(text: Column, reference: str = "2024-01-01 00:00:00") -> Column:
    """MM-DD HH:MM:SS.mmm of the reference's year."""
    p = rf"^(\d{{2}})-(\d{{2}})\s+{_CLOCK}(?:\.(\d{{1,9}}))?"
    g = lambda i: _part(F.trim(text), p, i)
    return F.when(F.trim(text).rlike(p), parts_ms(F.year(F.lit(reference).cast("timestamp_ntz")), g(1), g(2), g(3), g(4), g(5), g(6)))


def bsd_year_ms(text: Column, zone: str = "UTC") -> Column:
    """Mon DD YYYY HH:MM:SS."""
    p = rf"^([A-Z][a-z]{{2}})\s+(\d{{1,2}})\s+(\d{{4}})\s+{_CLOCK}"
    g = lambda i: _part(F.trim(text), p, i)
    return F.when(F.trim(text).rlike(p), local_ms(parts_ms(g(3), _month(g(1)), g(2), g(4), g(5), g(6)), zone))
