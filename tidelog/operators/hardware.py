"""Machine telemetry: rule points and the ranked crash verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, sequence

# Floors of the supply rails in volts, critical temperatures, and evidence lines by (pattern, cause, points).
RAIL_FLOORS = {12.0: 11.4, 5.0: 4.75, 3.3: 3.135}
CRITICAL = [("gpu", 103.0), ("cpu|core|tctl", 95.0), ("", 108.0)]
EVIDENCE = [("WHEA", "cpu_hardware", 4), (r"\bMCE\b|machine check", "cpu_hardware", 4), (r"\bEDAC\b|\bECC\b", "ram", 3), ("thermal", "thermal", 2), ("minidump", "driver_software", 2), ("throttle", "thermal", 1), ("panic report", "driver_software", 2), ("pstore", "driver_software", 2)]
HIGH, MEDIUM = 4.0, 2.5


def rail_nominal(volts: Column) -> Column:
    """The nominal rail within 15 % of a value, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for nominal in RAIL_FLOORS:
        out = out.when(F.abs(volts - nominal) <= 0.15 * nominal, F.lit(nominal))
    return out


def hottest(temps: Column) -> Column:
    """The largest entry of a map of temperatures as (value, key); null for an empty or missing map."""
    pairs = F.transform(F.map_entries(temps), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    return F.array_max(pairs)


def total_power(power: Column) -> Column:
    return F.when(F.size(power) > 0, F.aggregate(F.map_values(power), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))))


def critical_limit(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for pattern, limit in CRITICAL:
        out = out.when(F.lower(label).rlike(pattern), F.lit(limit))
    return out


def telemetry_points(samples: DataFrame, by: list[str], width_s: float = 86_400.0) -> DataFrame:
    """(by, cause, points, rule) from samples (by, ts_s, temp, temp_label, fan_rpm, volts, watts) in seconds and plain columns.

    Rules: hottest of the last 120 s at its limit; a rise of 10 degrees over 300 s to 85 or more; a stopped fan at 80 or more;
    the newer half's lowest rail below its floor, or else 4 % below the median; the last watts at 1.5 times the earlier median of 5 or more.
    """
    end = samples.groupBy(*by).agg(F.max("ts_s").alias("_end"))
    small = ranks.bounded(samples, by)
    rows = ranks.with_place(samples.join(end, by), by, ["ts_s"], width_s, "_i", "_n", small=small)
    age = F.col("_end") - F.col("ts_s")
    floor = reduce(lambda acc, p: acc.when(F.col("_rail") == p[0], F.lit(p[1])), RAIL_FLOORS.items(), F.when(F.lit(False), F.lit(0.0)))
    rows = rows.withColumn("_rail", rail_nominal(F.col("volts"))).withColumn("_floor", floor)
    newer = F.col("_i") > F.col("_n") / 2
    facts = rows.groupBy(*by).agg(
        F.max(F.when(age <= 120, F.col("temp") - critical_limit(F.col("temp_label")))).alias("over"),
        F.max_by(F.when(age <= 300, F.col("temp")), F.when(age <= 300, F.col("ts_s"))).alias("t_last"),
        F.min_by(F.when(age <= 300, F.col("temp")), F.when(age <= 300, F.col("ts_s"))).alias("t_first"),
        F.max(F.when(age <= 120, F.col("temp"))).alias("t_max"),
        F.max(F.when((F.col("fan_rpm") == 0) & (F.col("temp") >= 80), 1).otherwise(0)).alias("fan_stopped"),
        F.min(F.when(newer, F.col("volts") - F.col("_floor"))).alias("rail_gap"),
        F.min(F.when(newer, F.col("volts"))).alias("v_low"),
        F.max(F.when(age == 0, F.col("watts"))).alias("w_last"),
        F.count_if(age <= 600).alias("w_n"),
        # where a key may be large its medians come from ranks
        *([F.median("volts").alias("v_median"), F.median(F.when((age > 0) & (age <= 600), F.col("watts"))).alias("w_median")] if small else []),
    )
    if not small:
        late = rows.withColumn("_w", F.when((age > 0) & (age <= 600), F.col("watts")))
        facts = facts.join(ranks.medians(rows, by, "volts", "v_median"), by).join(ranks.medians(late, by, "_w", "w_median"), by)
    rules = [
        ("thermal", 3.0, "critical temperature", F.col("over") >= 0),
        ("thermal", 2.0, "temperature climbing", (F.col("t_last") - F.col("t_first") >= 10) & (F.col("t_last") >= 85)),
        ("fan_failure", 3.0, "fan stopped while hot", F.col("fan_stopped") == 1),
        ("psu_power", 3.0, "rail below its floor", F.col("rail_gap") < 0),
        ("psu_power", 2.0, "rail sagging", (F.coalesce(F.col("rail_gap"), F.lit(0.0)) >= 0) & (F.col("v_median") - F.col("v_low") >= 0.04 * F.col("v_median"))),
        ("psu_power", 2.0, "power spike", (F.col("w_n") >= 5) & (F.col("w_last") >= 1.5 * F.col("w_median"))),
    ]
    hits = F.array(*[F.struct(F.lit(c).alias("cause"), F.lit(p).alias("points"), F.lit(r).alias("rule"), F.coalesce(hit, F.lit(False)).alias("hit")) for c, p, r, hit in rules])
    return facts.select(*by, F.explode(F.filter(hits, lambda h: h["hit"])).alias("h")).select(*by, "h.cause", "h.points", "h.rule")


def postmortem_points(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, cause, points, rule) of evidence lines; each rule counts once a key."""
    rules = F.array(*[F.struct(F.lit(c).alias("cause"), F.lit(float(p)).alias("points"), F.lit(pattern).alias("rule")) for pattern, c, p in EVIDENCE])
    hits = lines.withColumn("h", F.explode(rules)).filter(F.expr(f"{line} rlike concat('(?i)', h.rule)"))
    return hits.select(*by, "h.cause", "h.points", "h.rule").distinct()


def verdict(points: DataFrame, by: list[str]) -> DataFrame:
    """Causes ranked by points: (by, rank, cause, score, confidence, evidence)."""
    scored = points.groupBy(*by, "cause").agg(F.sum("points").alias("score"), F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("evidence"))
    scored = scored.withColumn("confidence", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "cause")))


# What a machine's shutdown cause codes mean.
SHUTDOWN_CAUSES = {5: "normal", 3: "power button", 0: "power loss", -3: "temperature", -60: "bad disk", -61: "watchdog", -62: "watchdog", -64: "kernel panic", -71: "memory temperature", -74: "battery temperature", -75: "adapter", -78: "adapter current", -79: "battery current", -86: "proximity temperature", -95: "cpu temperature", -100: "supply temperature", -103: "battery voltage", -104: "battery", -128: "unknown"}


def shutdown_causes(lines: DataFrame, line: str) -> DataFrame:
    """(code, meaning, n) of shutdown-cause lines."""
    code = F.regexp_extract(line, r"(?i)shutdown cause:?\s*(-?\d+)", 1).try_cast("int")
    meaning = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SHUTDOWN_CAUSES.items() for x in p]), F.col("code")), F.lit("unknown"))
    return lines.select(code.alias("code")).filter(F.col("code").isNotNull()).groupBy("code").agg(F.count("*").alias("n")).withColumn("meaning", meaning)


def unclean_sessions(samples: DataFrame, by: list[str], ts: str, boot: str, width: float = sequence.STRETCH_MS) -> DataFrame:
    """Sessions whose last sample lies before the next boot: the boot's sample and the gap."""
    found = sequence.with_previous(samples, by, [ts], [ts], width).withColumn("previous_s", F.col(f"_p.{ts}")).drop("_b", "_p")
    return found.filter(F.col(boot) & F.col("previous_s").isNotNull()).withColumn("gap_s", F.col(ts) - F.col("previous_s"))


def metrics(samples: DataFrame, by: list[str], ts: str, now_s: float, window_s: float = 600) -> DataFrame:
    """Of the last window_s seconds, per key: hottest sensor and its temperature, highest and latest load, highest and latest watts. samples: ts in seconds, temps (a map), load, power (a map)."""
    recent = samples.filter((F.col(ts) > now_s - window_s) & (F.col(ts) <= now_s)).withColumn("_hot", hottest(F.col("temps"))).withColumn("_watts", total_power(F.col("power")))
    return recent.groupBy(*by).agg(
        F.max("_hot").alias("_h"), F.max("load").alias("load_max"), F.max_by("load", ts).alias("load_latest"), F.max("_watts").alias("watts_max"), F.max_by("_watts", ts).alias("watts_latest"), F.count("*").alias("samples")
    ).select(*by, F.col("_h.value").alias("hottest"), F.col("_h.key").alias("hottest_sensor"), "load_max", "load_latest", "watts_max", "watts_latest", "samples")


def rail_metrics(samples: DataFrame, by: list[str], ts: str, now_s: float, window_s: float = 600) -> DataFrame:
    """(by, rail, label, low, latest) of the last window_s seconds; samples have volts, a map by label. Rails go by value, or else by what the label says."""
    recent = samples.filter((F.col(ts) > now_s - window_s) & (F.col(ts) <= now_s)).select(*by, ts, F.explode("volts").alias("label", "value"))
    per = recent.groupBy(*by, "label").agg(F.min("value").alias("low"), F.max_by("value", ts).alias("latest"))
    return per.select(*by, labelled_rail(F.col("label"), F.col("latest")).alias("rail"), "label", "low", "latest")


def labelled_rail(label: Column, volts: Column) -> Column:
    """The nominal rail by value, or else by the number in the label (+12V, 5VSB, 3.3V, VCC3V3)."""
    plain = F.regexp_replace(F.lower(label), r"3v3|3,3|3\.3", "3.3v")
    by_label = F.when(plain.contains("12"), 12.0).when(plain.contains("3.3v"), 3.3).when(plain.rlike(r"(?<![\d.])5"), 5.0)
    return F.coalesce(rail_nominal(volts), by_label)


def bugcheck(text_: Column) -> Column:
    """The stop code of a power-loss event's text, decimal or hex; null where it names none."""
    shown = F.regexp_extract(text_, r"(?i)bug\s?check\s?code\W*(0x[0-9a-f]+|\d+)", 1)
    return F.when(shown.startswith("0x"), F.conv(F.substring(shown, 3, 20), 16, 10).try_cast("long")).otherwise(shown.try_cast("long"))


#: Words by which a line tells of the hardware.
HARDWARE_WORDS = ["whea", "mce", "machine check", "edac", "ecc", "thermal", "throttl", "over-current", "overcurrent", "under-voltage", "undervoltage", "watchdog", "hardware error"]


def hardware_lines(lines: DataFrame, line: str, order: list[str], cap: int = 80) -> DataFrame:
    """The last `cap` lines that tell of the hardware, as a report."""
    words = r"(?i)(?<![a-z])(?:" + "|".join(w.replace(" ", r"\s+").replace("-", "-?") for w in HARDWARE_WORDS) + ")"
    return lines.filter(F.col(line).rlike(words)).orderBy(*[F.desc(o) for o in order]).limit(cap)


# What a machine's own cause of shutdown says: (meanings, cause, points).
OWN_CAUSES = [(["temperature", "memory temperature", "battery temperature", "proximity temperature", "cpu temperature", "supply temperature"], "thermal", 4.0), (["power loss", "adapter", "adapter current", "battery", "battery current", "battery voltage"], "psu_power", 3.0), (["watchdog", "kernel panic"], "driver_software", 2.0)]


def boot_points(boots: DataFrame, by: list[str]) -> DataFrame:
    """(by, cause, points, rule) of what the next boot knows: boots has by, rebooted, bugcheck, software (other software evidence), t_max, and shutdown (a meaning).

    A reboot below 85 degrees without software evidence and a zero stop code speak for the supply, another stop code for a driver.
    """
    rules = [
        ("psu_power", 2.0, "rebooted cool without software evidence", F.col("rebooted") & (F.col("t_max") < 85) & ~F.col("software") & (F.coalesce(F.col("bugcheck"), F.lit(0)) == 0)),
        ("driver_software", 3.0, "stop code", F.col("bugcheck") != 0),
        ("psu_power", 1.0, "zero stop code", F.col("rebooted") & (F.col("bugcheck") == 0)),
        *[(cause, points, "shutdown cause: " + cause, F.col("shutdown").isin(meanings)) for meanings, cause, points in OWN_CAUSES],
    ]
    hits = F.array(*[F.struct(F.lit(c).alias("cause"), F.lit(p).alias("points"), F.lit(r).alias("rule"), F.coalesce(hit, F.lit(False)).alias("hit")) for c, p, r, hit in rules])
    return boots.select(*by, F.explode(F.filter(hits, lambda h: h["hit"])).alias("h")).select(*by, "h.cause", "h.points", "h.rule")


def crash_report(points: DataFrame, boots: DataFrame, by: list[str]) -> DataFrame:
    """The ranked verdict of sessions that rebooted; a session that did not is never called a crash."""
    return verdict(points.join(boots.filter("rebooted").select(*by), by, "left_semi"), by)


def sensor_tree(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """(key, kind, sensor, value) of a tree of {Text, Value, Children} nodes as sensor services print it: units tell the kind, Fahrenheit becomes Celsius, comma decimals are read. The sensor is its path of texts."""
    from . import state

    flat = state.flatten(rows, key, json, max_depth=16, max_keys=20_000)
    node = F.regexp_replace("path", r"\.?(?:Value|Text)$", "")
    values = flat.filter(F.col("path").rlike(r"(?:^|\.)Value$") & F.col("value").rlike(r"\d")).select(*key, node.alias("node"), F.col("value").alias("shown"))
    names = flat.filter(F.col("path").rlike(r"(?:^|\.)Text$")).select(*key, node.alias("at"), F.col("value").alias("name"))
    # a node's name is the texts of itself and of the nodes above, which are its path cut at every child
    links = F.regexp_extract_all("node", F.lit(r"\.?Children\[\d+\]"), F.lit(0))
    steps = F.transform(F.sequence(F.lit(0), F.size(links)), lambda i: F.array_join(F.slice(links, F.lit(1), i), ""))
    up = values.select(*key, "node", "shown", F.posexplode(steps).alias("depth", "at"))
    named = up.join(names, [*key, "at"]).groupBy(*key, "node", "shown").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]), "/").alias("sensor"))
    number = F.regexp_replace(F.regexp_extract("shown", r"(-?\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double")
    unit = F.trim(F.regexp_extract("shown", r"\d\s*([^\d\s.,]\S*)\s*$", 1))
    kind = F.when(unit.isin("°C", "°F", "C", "F"), "temp").when(unit == "RPM", "fan").when(unit == "V", "volt").when(unit == "W", "power").when(unit == "%", "load")
    value = F.when(unit.isin("°F", "F"), F.round((number - 32) / 1.8, 4)).otherwise(number)
    return named.select(*key, kind.alias("kind"), "sensor", value.alias("value")).filter(F.col("kind").isNotNull())


def sample_maps(readings: DataFrame, key: list[str]) -> DataFrame:
    """One sample a key: maps by sensor of temperatures, fans, volts, powers and loads, from (key, kind, sensor, value)."""
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("sensor", "value")))))
    once = readings.groupBy(*key, "kind", "sensor").agg(F.max("value").alias("value"))
    return once.groupBy(*key).agg(of("temp").alias("temps"), of("fan").alias("fans"), of("volt").alias("volts"), of("power").alias("power"), of("load").alias("loads"))
