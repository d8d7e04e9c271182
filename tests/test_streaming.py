from pyspark.sql import functions as F

from tidelog.operators import signals
from tidelog.plans import catalogue
from tidelog.streaming import stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def events(spark):
    return stream.timed(stream.read_parquet(spark, "/root/testdata/sf0.001/events*.parquet", spark.read.parquet(EVENTS).schema))


def test_tumbling_equals_batch_for_closed_windows(spark, tmp_path):
    stream.run_once(stream.tumbling(events(spark), "event_type", "1 day"), "tumbling", str(tmp_path / "c"))
    got = {(str(r["start"]), r["event_type"], r["n"]) for r in spark.table("tumbling").collect()}
    batch = spark.read.parquet(EVENTS).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n"))
    want = {(str(r["window"]["start"]), r["event_type"], r["n"]) for r in batch.collect()}
    assert got and got <= want


def test_watches_equal_batch(spark, tmp_path):
    watches = [{"name": "errors", "category": "error"}]
    as_events = lambda d: d.select("event_id", F.col("event_type").alias("category"), "props", F.lit("INFO").alias("level"), F.lit("").alias("source"), F.lit(0).alias("ts_ms"))
    stream.run_once(stream.watch_hits(as_events(events(spark)), watches), "hits", str(tmp_path / "c"))
    assert spark.table("hits").count() == signals.watch_hits(as_events(spark.read.parquet(EVENTS)), watches).count() > 0


def test_rate_limit_per_tier(spark, tmp_path):
    rows = [("s", f"f{i}", 3, i * 4000.0) for i in range(10)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "session string, fp string, tier int, ts_ms double").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = stream.read_parquet(spark, str(tmp_path / "in"), "session string, fp string, tier int, ts_ms double")
    stream.run_once(stream.rate_limited(source), "limited", str(tmp_path / "c"))
    assert sorted(r["ts_ms"] for r in spark.table("limited").collect()) == [0.0, 12000.0, 24000.0, 36000.0]


def test_suppression(spark, tmp_path):
    rows = [("s", "a", 1, 1.0), ("s", "a", 1, 2.0), ("s", "a", 2, 3.0), ("t", "a", 1, 4.0)]
    spark.createDataFrame(rows, "session string, fp string, tier int, ts_ms double").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = stream.read_parquet(spark, str(tmp_path / "in"), "session string, fp string, tier int, ts_ms double")
    stream.run_once(stream.suppressed(source), "surfaced", str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.table("surfaced").collect()) == [("s", "a", 1, 1.0), ("s", "a", 2, 3.0), ("t", "a", 1, 4.0)]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
