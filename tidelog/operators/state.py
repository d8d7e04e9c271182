"""Nested state as flat keys, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of flattening.
MAX_DEPTH, MAX_KEYS, MAX_ITEMS, CLIP = 6, 400, 100, 200


def flatten(rows: DataFrame, key: list[str], json: str, max_depth: int = MAX_DEPTH, max_keys: int = MAX_KEYS) -> DataFrame:
    """(key, path, value): leaves of JSON objects and lists as dotted paths with [i], all levels opened within the row.

    Levels below max_depth stay JSON text; lists give their first 100 items; a row gives max_keys leaves at most, by path
    order within each object; values are clipped to 200 characters; text that is no JSON object or list gives no rows.
    """

    def opened(item: Column) -> Column:
        path, v = item["path"], item["v"]
        kind = F.schema_of_variant(v)
        below = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.when(path == "", e["key"]).otherwise(F.concat_ws(".", path, e["key"])).alias("path"), e["value"].alias("v")))
        items = F.transform(F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, MAX_ITEMS), lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")))
        return F.when(kind.startswith("OBJECT<"), below).when(kind.startswith("ARRAY<"), items).otherwise(F.array(F.struct(path.alias("path"), v.alias("v"))))

    found = rows.select(*key, F.try_parse_json(json).alias("_v")).filter(F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<"))
    level = F.array(F.struct(F.lit("").alias("path"), F.col("_v").alias("v")))
    for _ in range(max_depth):
        level = F.flatten(F.transform(level, opened))
    leaf = F.explode(F.slice(level, 1, max_keys)).alias("_l")
    value = F.substring(F.coalesce(F.try_variant_get("_l.v", "$", "string"), F.to_json("_l.v")), 1, CLIP)
    return found.select(*key, leaf).select(*key, F.col("_l.path").alias("path"), value.alias("value"))


def state_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change (added, removed, changed), from_value and to_value; equal values give no row."""
    x, y = a.select(*keys, F.col(value).alias("from_value")), b.select(*keys, F.col(value).alias("to_value"))
    x, y = x.withColumn("_a", F.lit(True)), y.withColumn("_b", F.lit(True))
    both = x.join(y, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("from_value").eqNullSafe(F.col("to_value")), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(*keys, "change", "from_value", "to_value")


def map_delta(previous: Column, current: Column, cap: int = 30) -> Column:
    """Added, removed and changed of two maps, each side capped, counts not; truncated says if any was."""
    a, b = F.coalesce(previous, F.create_map().cast("map<string,string>")), F.coalesce(current, F.create_map().cast("map<string,string>"))
    added = F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k))
    removed = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    kept = F.map_filter(b, lambda k, v: F.map_contains_key(a, k) & ~F.try_element_at(a, k).eqNullSafe(v))
    changed = F.transform_values(kept, lambda k, v: F.struct(F.try_element_at(a, k).alias("from"), v.alias("to")))
    cut = lambda m: F.map_from_entries(F.slice(F.array_sort(F.map_entries(m)), 1, cap))
    sizes = [F.size(added), F.size(removed), F.size(changed)]
    return F.struct(cut(added).alias("added"), cut(removed).alias("removed"), F.map_from_entries(F.slice(F.map_entries(changed), 1, cap)).alias("changed"), sizes[0].alias("n_added"), sizes[1].alias("n_removed"), sizes[2].alias("n_changed"), (F.greatest(*sizes) > cap).alias("truncated"))


def reconcile(configured: DataFrame, written: DataFrame, stale_after_s: float = 120.0) -> DataFrame:
    """Paths by whether they are configured and written: ok, stale, silent (never written) or unlisted."""
    c, w = configured.select("path").distinct().withColumn("_c", F.lit(True)), written.groupBy("path").agg(F.min("age_s").alias("age_s")).withColumn("_w", F.lit(True))
    verdict = F.when(F.col("_c").isNull(), "unlisted").when(F.col("_w").isNull(), "silent").when(F.col("age_s") > stale_after_s, "stale").otherwise("ok")
    return c.join(w, "path", "full_outer").select("path", verdict.alias("verdict"), "age_s")
