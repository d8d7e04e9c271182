"""Interface trees and pixel regions: the recursive operators, in Arrow batches or level by level."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles that hold others and say nothing themselves.
CONTAINERS = {"group", "pane", "panel", "layout", "scrollarea", "splitgroup", "unknown", "generic", "section"}
NODE_CAP = 150
ROWS = "id string, depth int, role string, text string, x double, y double, w double, h double"


_TOKEN = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))')


def parsed_json(text: str):
    """What json.loads gives, for nesting of any depth; ValueError for what is no JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    root: list = []
    stack: list = [root]  # open lists and objects; an object waits for a key, or has one
    keys: list = [None]
    at, state = 0, "value"  # what may come next: value, first (value or end), key, colon, next
    while at < len(text):
        if text[at:].isspace():
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, value = m[1], None
        if mark in ("[", "{") and state in ("value", "first"):
            value = [] if mark == "[" else {}
        elif mark in ("]", "}") and state in ("first", "next", "key1") and len(stack) > 1 and isinstance(stack[-1], list if mark == "]" else dict):
            stack.pop()
            keys.pop()
            state = "next"
            continue
        elif mark == "," and state == "next" and len(stack) > 1:
            state = "key" if isinstance(stack[-1], dict) else "value"
            continue
        elif mark == ":" and state == "colon":
            state = "value"
            continue
        elif mark is None and state in ("key", "key1") and m[2]:
            keys[-1], state = json.loads(m[2]), "colon"
            continue
        elif mark is None and state in ("value", "first"):
            value = json.loads(m[2] or m[3])
        else:
            raise ValueError(f"no JSON at {at}")
        holder = stack[-1]
        if isinstance(holder, dict):
            holder[keys[-1]] = value
        else:
            holder.append(value)
        state = "next"
        if mark:
            stack.append(value)
            keys.append(None)
            state = "first" if mark == "[" else "key1"
    if len(stack) != 1 or len(root) != 1 or state != "next":
        raise ValueError("unfinished JSON")
    return root[0]


def prune(nodes: list[dict], cap: int = NODE_CAP) -> list[dict]:
    """Invisible nodes go with all below; empty containers give way to their children; leaves that say nothing go; at most `cap` nodes stay. Open nodes stand on a stack of their own, so depth has no limit."""
    out: list[dict] = []
    left = cap
    stack: list = [(iter(nodes), out, None, None)]  # children to come, where kept ones go, the node that they are of, and where it goes itself
    while stack:
        some, kept, node, above = stack[-1]
        n = next(some, None)
        if n is None:
            stack.pop()
            if node is not None:
                if kept or (node.get("text") or "").strip():
                    above.append({**node, "children": kept})
                else:
                    left += 1
            continue
        x, y, w, h = (n.get("bbox") or [0, 0, 1, 1])[:4]
        if n.get("visible") is False or w <= 0 or h <= 0:
            continue
        children = iter(n.get("children") or [])
        if not (n.get("text") or "").strip() and (n.get("role") or "").lower() in CONTAINERS:
            stack.append((children, kept, None, None))
        elif left <= 0:
            stack[-1] = (iter(()), kept, node, above)
        else:
            left -= 1
            stack.append((children, [], n, kept))
    return out


def flatten(trees: DataFrame, key: str, tree: str, pruned: bool = True) -> DataFrame:
    """(id, depth, role, text, x, y, w, h) of each tree's nodes, depth first; a text that is no JSON list gives none."""

    def run(frames):
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[tree]):
                try:
                    nodes = parsed_json(t) if t else []
                except ValueError:
                    nodes = []
                stack = [(n, 0) for n in reversed(prune(nodes) if pruned else nodes)] if isinstance(nodes, list) else []
                while stack:
                    n, depth = stack.pop()
                    x, y, w, h = (n.get("bbox") or [0, 0, 0, 0])[:4]
                    rows.append((str(k), depth, n.get("role") or "", n.get("text") or "", float(x), float(y), float(w), float(h)))
                    stack += [(c, depth + 1) for c in reversed(n.get("children") or [])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    return trees.select(key, tree).mapInPandas(run, ROWS)


def tree_diff(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, role, cx, cy, change, before, after): of each tree the nodes added, removed or with another text, matched by role and place in cells of eight pixels; of several in one cell the least text stands for it."""
    by = by or []
    place = [F.floor(F.col(c) / 8).cast("long").alias(f"c{c}") for c in "xy"]
    key = [*by, "role", "cx", "cy"]
    side = lambda d, name: d.select(*by, "role", *place, F.col("text").alias(name)).groupBy(*key).agg(F.min(name).alias(name), F.lit(True).alias(f"has_{name}"))
    both = side(before, "before").join(side(after, "after"), key, "full_outer")
    change = F.when(F.col("has_before").isNull(), "added").when(F.col("has_after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(*key, "change", "before", "after")


def grid_cells(rows: DataFrame, key: str, values: Column, width: int) -> DataFrame:
    """(key, x, y, grey) of grids that stand row by row in an array of shades from 0 to 255."""
    return rows.select(key, F.posexplode(values).alias("_i", "grey")).select(key, (F.col("_i") % width).cast("int").alias("x"), F.floor(F.col("_i") / width).cast("int").alias("y"), F.col("grey").cast("int").alias("grey"))


def quadtree(cells: DataFrame, by: list[str], size: int, tau: float = 0.35, max_depth: int = 4, least: int = 1) -> DataFrame:
    """(by, x, y, side, entropy): the leaves of each square image of `size` (a power of two), split while the entropy of a square's 16 shades, as a share of 4 bits, exceeds tau, its side is 2 * least or more and max_depth is not reached.

    One aggregate a level over the image's shades, from single cells' counts upwards, and one join a level from the whole image down; no image meets in one task.
    """
    counts = cells.groupBy(*by, "x", "y", F.shiftright("grey", 4).alias("shade")).agg(F.count("*").alias("n"))
    depths = 0
    while depths < max_depth and size >> depths >= 2 * least and size >> depths > 1:
        depths += 1
    open_ = cells.select(*by).distinct().withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    leaves = None
    for depth in range(depths + 1):
        side = size >> depth
        at = [(F.floor(F.col(c) / side) * side).cast("int").alias(c) for c in "xy"]
        shades = counts.groupBy(*by, *at, "shade").agg(F.sum("n").alias("n"))
        parts = shades.groupBy(*by, "x", "y").agg(F.sum("n").alias("_t"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
        # -sum(p log p) = log t - sum(n log n) / t
        level = parts.select(*by, "x", "y", F.lit(side).alias("side"), F.round((F.log2("_t") - F.col("_s") / F.col("_t")) / 4, 9).alias("entropy"))
        here = open_.join(level, [*by, "x", "y"])
        done = here if depth == depths else here.filter(F.col("entropy") <= tau)
        leaves = done if leaves is None else leaves.unionByName(done)
        half = side // 2
        quarters = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (0, half) for dy in (0, half)])
        open_ = here.filter(F.col("entropy") > tau).select(*by, F.explode(quarters).alias("q")).select(*by, F.col("q.x").cast("int").alias("x"), F.col("q.y").cast("int").alias("y"))
    return leaves


def regions(pixels: np.ndarray, tau: float = 0.35, max_depth: int = 4, least: int = 32) -> list[tuple[int, int, int, int]]:
    """Quadtree: (x, y, w, h) of the leaves of a grey image, split while their entropy over 16 shades, as a share of 4 bits, exceeds tau."""
    out = []

    def split(x: int, y: int, w: int, h: int, depth: int) -> None:
        part = pixels[y : y + h, x : x + w]
        n = np.bincount(part.ravel() >> 4, minlength=16)
        p = n[n > 0] / max(1, part.size)
        if depth >= max_depth or min(w, h) < 2 * least or -(p * np.log2(p)).sum() / 4 <= tau:
            out.append((x, y, w, h))
            return
        a, b = w // 2, h // 2
        for dx, dy, ww, hh in ((0, 0, a, b), (a, 0, w - a, b), (0, b, a, h - b), (a, b, w - a, h - b)):
            split(x + dx, y + dy, ww, hh, depth + 1)

    split(0, 0, pixels.shape[1], pixels.shape[0], 0)
    return out


def image_regions(images: DataFrame, key: str, width: str, height: str, grey: str, tau: float = 0.35) -> DataFrame:
    """(id, x, y, w, h) of the leaves of each image, whose grey bytes stand row by row."""

    def run(frames):
        for frame in frames:
            rows = [(str(k), *r) for k, w, h, g in zip(frame[key], frame[width], frame[height], frame[grey]) if g is not None and len(g) == w * h for r in regions(np.frombuffer(g, np.uint8).reshape(h, w), tau)]
            yield pd.DataFrame(rows, columns=["id", "x", "y", "w", "h"])

    return images.select(key, width, height, grey).mapInPandas(run, "id string, x int, y int, w int, h int")


def dominant_colours(pixels: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The k most frequent colours (r, g, b) of each key in buckets of 4 bits, with their share."""
    bucket = [F.shiftright(c, 4).alias(c) for c in "rgb"]
    n = pixels.select(*by, *bucket).groupBy(*by, *"rgb").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    ranked = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), *"rgb")))
    return ranked.filter(F.col("rank") <= k)
