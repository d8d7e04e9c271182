"""Trees and grids: against recursive versions, and trees of any depth."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import parsing, trees
from tidelog.sources import text as sources


def prune_by_force(nodes, cap):
    left = [cap]

    def walk(some):
        out = []
        for n in some:
            _, _, w, h = (n.get("bbox") or [0, 0, 1, 1])[:4]
            if n.get("visible") is False or w <= 0 or h <= 0:
                continue
            says = bool((n.get("text") or "").strip())
            if not says and (n.get("role") or "").lower() in trees.CONTAINERS:
                out += walk(n.get("children") or [])
                continue
            if left[0] <= 0:
                break
            left[0] -= 1
            below = walk(n.get("children") or [])
            if says or below:
                out.append({**n, "children": below})
            else:
                left[0] += 1
        return out

    return walk(nodes)


def some_tree(rng, depth=0):
    node = {"role": rng.choice(["group", "button", "Pane", "text", None]), "text": rng.choice(["", " ", "hello", "x", None])}
    if rng.random() < 0.2:
        node["visible"] = rng.choice([True, False])
    if rng.random() < 0.3:
        node["bbox"] = [1, 2, rng.choice([0, 3]), 4]
    if depth < 6 and rng.random() < 0.8:
        node["children"] = [some_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return node


@pytest.mark.parametrize("cap", [3, 10, 150])
def test_prune_equals_recursion(cap):
    rng = random.Random(cap)
    for _ in range(200):
        forest = [some_tree(rng) for _ in range(3)]
        assert trees.prune(forest, cap) == prune_by_force(forest, cap)


def test_a_tree_of_ten_thousand_levels(spark):
    deep = '[{"role": "group", "children": ' * 10_000 + '[{"role": "button", "text": "end", "bbox": [1, 2, 3, 4]}]' + "}]" * 10_000
    titled = '[{"role": "pane", "text": "t", "children": ' * 3000 + "[]" + "}]" * 3000
    rows = spark.createDataFrame([("deep", deep), ("titled", titled), ("bad", deep[:-1]), ("none", None), ("list", "3")], "id string, tree string")
    got = trees.flatten(rows, "id", "tree").groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()
    assert {r["id"]: (r["n"], r["d"]) for r in got} == {"deep": (1, 0), "titled": (150, 149)}


def test_parsing_without_recursion_equals_json(monkeypatch):
    rng = random.Random(1)

    def value(d=0):
        kind = rng.randrange(7 if d < 5 else 4)
        if kind < 4:
            return rng.choice([None, True, 1.5, -3, 'a"b\\c,[{', "é\n", ""])
        return [value(d + 1) for _ in range(rng.randint(0, 3))] if kind < 6 else {f"k{i}": value(d + 1) for i in range(rng.randint(0, 3))}

    texts = [json.dumps(value()) for _ in range(300)] + ["[1, 2", "[1,]", "{", '{"a"}', '{"a":}', '{"a":1,}', "1 2", "", "[}", "nul", '[1 2]', '{1:2}', "]", ",", '{"a":1 "b":2}', "[,1]"]
    real = json.loads

    def limited(t, *a):
        if t[:1] in "[{" or t[:1].isspace():
            raise RecursionError
        return real(t, *a)

    for t in texts:
        try:
            want = real(t)
        except ValueError:
            want = ValueError
        monkeypatch.setattr(trees.json, "loads", limited)
        try:
            got = trees.parsed_json(t)
        except ValueError:
            got = ValueError
        finally:
            monkeypatch.setattr(trees.json, "loads", real)
        assert got == want, t


def leaves_by_force(image, x, y, side, depth, tau, max_depth, least):
    shades = [image[j][i] >> 4 for j in range(y, y + side) for i in range(x, x + side)]
    p = [shades.count(s) / len(shades) for s in set(shades)]
    entropy = -sum(q * math.log2(q) for q in p) / 4
    if entropy <= tau or depth >= max_depth or side < 2 * least or side == 1:
        return [(x, y, side)]
    half = side // 2
    return [leaf for dx in (0, half) for dy in (0, half) for leaf in leaves_by_force(image, x + dx, y + dy, half, depth + 1, tau, max_depth, least)]


@pytest.mark.parametrize("size, max_depth, least, tau", [(8, 4, 1, 0.3), (16, 2, 1, 0.35), (16, 4, 4, 0.1), (1, 4, 1, 0.1)])
def test_quadtree_equals_recursion(spark, size, max_depth, least, tau):
    rng = random.Random(size)
    images = {k: [[rng.choice([0, 16, 200]) if (i < size // 2) == (k % 2 == 0) else 50 for i in range(size)] for j in range(size)] for k in range(6)}
    cells = spark.createDataFrame([(k, [v for row in image for v in row]) for k, image in images.items()], "k int, g array<int>")
    got = trees.quadtree(trees.grid_cells(cells, "k", F.col("g"), size), ["k"], size, tau, max_depth, least).collect()
    assert sorted((r["k"], r["x"], r["y"], r["side"]) for r in got) == sorted((k, *leaf) for k, image in images.items() for leaf in leaves_by_force(image, 0, 0, size, 0, tau, max_depth, least))


def test_one_line_gives_its_event(spark):
    line = "2024-01-05 10:00:00,123 [main] WARN com.acme.Service - disk almost full"
    r = parsing.test_event(spark, line).first()
    assert (r["level"], r["message"], r["ts_ms"]) == ("WARN", "disk almost full", 1704448800123.0) and r["score"] > 0.5
    raw = parsing.test_event(spark, "nothing to see").first()
    assert raw["message"] == "nothing to see"


def test_newest_report_and_aliases(spark):
    files = spark.createDataFrame([("m", "/x/stats_1.log", 1, "FPS: 10"), ("m", "/x/stats_2.log", 2, "| Frames per second: 60 |\n| Frame Time: 16 ms |\nFrame time: 17 ms"), ("m", "/x/other.log", 3, "FPS: 1"), ("n", "/x/stats_1.log", 1, "fps: 5\nFrames per second: 6")], "k string, path string, modified int, text string")
    got = {r["k"]: (r["path"], r["values"]) for r in sources.latest_report(files, ["k"], {"frames_per_second": "fps"}).collect()}
    assert got == {"m": ("/x/stats_2.log", {"fps": "60", "frame_time": "17 ms"}), "n": ("/x/stats_1.log", {"fps": "5"})}
