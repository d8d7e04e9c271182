"""The index of addresses by the keys under which lines name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def _fields(lines: DataFrame, line: str, weight: str | None, order: list[str] | None) -> DataFrame:
    """(address, role, w, line, at) of every field of a line that holds an address; only fields that can hold one are looked at twice."""
    rows = lines.filter(F.trim(line) != "").select(F.col(line).alias("line"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), F.struct(*(order or [line])).alias("at"), F.explode(F.filter(text.field_pairs(F.col(line)), lambda p: F.length(p["value"]) >= 6)).alias("f"))
    rows = rows.select(text.value_address(F.col("f.value")).alias("address"), F.col("f.key").alias("role"), "w", F.substring("line", 1, 200).alias("line"), "at")
    return rows.filter(F.col("address").isNotNull() & ~F.lower("role").isin(text.NON_ROLE_KEYS))


def address_roles(lines: DataFrame, line: str, weight: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(address, role, n, first_line, last_line): how often each address stands under each key, weighted by repeats, and the lines that name it so first and last in this order (without one, the smallest and the largest line).

    Keys of sizes, counts and times are no roles. Rows pre-aggregate before they shuffle; lines are clipped to 200 characters.
    """
    return _fields(lines, line, weight, order).groupBy("address", "role").agg(F.sum("w").alias("n"), F.min_by("line", "at").alias("first_line"), F.max_by("line", "at").alias("last_line"))


def totals(roles: DataFrame) -> DataFrame:
    return roles.groupBy("address").agg(F.sum("n").alias("total"), F.count("*").alias("roles"))


def never(roles: DataFrame, role: str) -> DataFrame:
    """Addresses that never stand under the key, most frequent first: one aggregate over the index."""
    out = roles.groupBy("address").agg(F.sum("n").alias("total"), F.count("*").alias("roles"), F.count_if(F.col("role") == role).alias("_has"))
    return out.filter(F.col("_has") == 0).drop("_has").orderBy(F.desc("total"), "address")


def tokens(column: Column, limit: int | None = None) -> Column:
    """What a text claims that a log can confirm, distinct and in this order: addresses, key=value pairs of four characters or more, numbers of four or more."""
    hexes = text.addresses(column)
    pairs = F.filter(F.transform(text.field_pairs(column), lambda p: F.concat(p["key"], F.lit("="), p["value"])), lambda x: F.length(x) >= 4)
    numbers = F.filter(F.regexp_extract_all(column, F.lit(text.NUMBER), F.lit(1)), lambda x: F.length(x) >= 4)
    out = F.array_distinct(F.concat(hexes, pairs, numbers))
    return F.slice(out, 1, limit) if limit else out


def corroborated(claims: DataFrame, claim: str, tokens: DataFrame, token: str) -> DataFrame:
    """claims + corroborated: whether the token stands in the log's tokens, which are made distinct first."""
    known = tokens.select(F.col(token).alias("_t")).distinct().withColumn("_yes", F.lit(True))
    return claims.join(known, F.col(claim) == F.col("_t"), "left").withColumn("corroborated", F.coalesce("_yes", F.lit(False))).drop("_t", "_yes")
