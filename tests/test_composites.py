import json
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidelog.operators import composites, retention, signals, trees


def test_prune_and_flatten(spark):
    tree = [{"role": "group", "bbox": [0, 0, 9, 9], "children": [{"role": "button", "text": "OK", "bbox": [1, 1, 5, 5]}, {"role": "image", "bbox": [0, 0, 0, 0]}, {"role": "image", "bbox": [1, 1, 2, 2]}]}, {"role": "window", "text": "W", "bbox": [0, 0, 9, 9], "children": [{"role": "label", "text": "x", "bbox": [16, 8, 2, 2]}]}]
    rows = [(1, json.dumps(tree)), (2, "no json"), (3, None)]
    got = trees.flatten(spark.createDataFrame(rows, "id int, tree string"), "id", "tree").collect()
    assert [(r["depth"], r["role"]) for r in got] == [(0, "button"), (0, "window"), (1, "label")]
    after = spark.createDataFrame([("1", 0, "button", "Go", 1.0, 1.0, 5.0, 5.0)], trees.ROWS)
    changes = {(r["role"], r["change"]) for r in trees.tree_diff(spark.createDataFrame(got, trees.ROWS), after).collect()}
    assert changes == {("button", "changed"), ("window", "removed"), ("label", "removed")}


def test_regions_split_where_there_is_detail():
    image = np.zeros((256, 256), np.uint8)
    assert len(trees.regions(image)) == 1
    image[:128, :128] = np.random.default_rng(0).integers(0, 256, (128, 128))
    found = trees.regions(image, tau=0.2)
    assert len(found) > 1 and sum(w * h for _, _, w, h in found) == 256 * 256


def test_combined_timeline(spark):
    rows = lambda *ts: spark.createDataFrame([(float(t), "x" * 200) for t in ts], "ts_ms double, line string")
    got = composites.combined_timeline(rows(1, 5), rows(2, 3, 4), rows(6), limit=4).collect()
    assert [r["ts_ms"] for r in got] == [3, 4, 5, 6] and len(got[0]["line"]) == 160


def test_error_moment(spark):
    errors = spark.createDataFrame([("p", 10_000, 1)], "k string, ts_ms long, id int")
    frames = spark.createDataFrame([("p", 9_000, 7), ("p", 12_000, 8)], "k string, s_ts_ms long, seq int")
    states = spark.createDataFrame([("p", 8_000, "s")], "k string, s_ts_ms long, v string")
    logs = spark.createDataFrame([("p", 4_000, "ERROR"), ("p", 16_000, "INFO"), ("p", 16_001, "INFO")], "k string, r_ts_ms long, r_level string")
    r = composites.error_moment(errors, frames, logs, states, ["k"]).first()
    assert (r["frame"]["seq"], r["state"]["v"], r["rows_near"], r["errors_near"]) == (7, "s", 2, 1)


def test_chosen_signals_keep_a_place_for_a_deadline(spark):
    rows = [("s", 3, i, False, False) for i in range(4)] + [("s", 3, 9, True, False), ("s", 2, 10, False, True)]
    frame = spark.createDataFrame(rows, "k string, tier int, no int, deadline boolean, correction boolean")
    got = [r["no"] for r in signals.chosen(frame, ["k"], "tier", ["no"]).collect()]
    assert len(got) == 3 and 9 in got and 10 in got


def test_eviction_leaves_a_small_ledger_alone(spark):
    frame = spark.createDataFrame([(1, 10, 0.1), (2, 10, 0.2)], "seq int, bytes long, interest double")
    assert retention.eviction(frame, "bytes", F.lit(0), "interest", "seq", "seq", 100).count() == 0
    assert [r["seq"] for r in retention.eviction(frame, "bytes", F.lit(0), "interest", "seq", "seq", 20).collect()] == [1]


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
