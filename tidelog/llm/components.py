"""Connected components of a link table by alternating stars, with stored tables at each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller (small) neighbours under its smallest one."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = common.stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = common.stored(out.filter(F.col("a") != F.col("b")).distinct())
    common.release(least, edges)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in the links (a, b), two longs: component_id is the smallest id that the id is linked with, however far."""
    edges = common.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
