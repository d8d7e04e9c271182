"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that depends only on
the ids, sent up to `cap` times over. A document's virtual finish time is the
number of words its queue has sent up to and including it, divided by the
source's target. The mix is the global order of finish times, cut where the
total budget is spent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents in one run of the shuffled order, ranges that virtual time is cut into at each step (a power of two, so that cutting is exact), and turns in a range that one task may sort.
RUN_ROWS, RANGES, EDGE_ROWS = 512, 4096, 100_000


def fill_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share the sum of sizes by weight; a target stops at cap times its size and the excess is shared anew."""
    targets, left, open_ = [0.0] * len(sizes), float(sum(sizes)), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """One row per distinct (doc_id, source, size) with size, source_size, target and taken, the words the mix takes of each such row.

    Sizes count words; a null or empty text has size 0 and is taken 0 words. A null source is a source of its own,
    after all others; a null doc_id is an id like any other. Rows that agree in id, source and size are taken alike.
    The only data on the driver are one row per source and RANGES sums a step.
    """
    spark = docs.sparkSession
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(common.WORD))).cast("long")
    rows = common.checkpointed(docs.select(F.col("doc_id"), F.col("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = fill_targets([r.source_size for r in found], [float(weights[i % len(weights)]) for i in range(len(found))], cap)
    table = spark.createDataFrame([(r.source, i, r.source_size, t) for i, (r, t) in enumerate(zip(found, targets))], "source string, rank int, source_size long, target double")
    runs = max(1, -(-sum(r.n for r in found) // RUN_ROWS))
    order = ["place", "hash", "doc_id", "size"]
    rows = rows.withColumn("hash", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("place", F.shiftrightunsigned("hash", 40))
    rows = rows.withColumn("run", F.floor(F.col("place") * F.lit(runs) / F.lit(1 << 24)).cast("long"))
    rows = rows.join(F.broadcast(table) if len(found) <= 100_000 else table, rows.source.eqNullSafe(table.source)).drop(table.source)
    words = F.col("size") * F.col("copies")
    before = rows.groupBy("rank", "run").agg(F.sum(words).alias("sum"))
    before = before.select("rank", "run", (F.sum("sum").over(Window.partitionBy("rank").orderBy("run")) - F.col("sum")).alias("before"))
    queue = rows.join(before, ["rank", "run"]).withColumn("sent", F.col("before") + F.sum(words).over(Window.partitionBy("rank", "run").orderBy(*order)))
    queue = common.checkpointed(queue.select("doc_id", "source", "size", "copies", "rank", "hash", "source_size", "target", "sent"))
    finish = [F.try_divide(F.col("sent") + F.lit(e) * F.col("source_size"), F.col("target")) for e in range(cap)]
    turns = queue.withColumn("finish", F.explode(F.array(*finish))).filter(F.col("finish") < 2)
    left = sum(r.source_size for r in found)
    # the range in which the budget runs out, cut again until few turns are left in it
    edge, scale, rows_in = None, 1, None
    while (edge is None and scale == 1) or (edge is not None and rows_in > EDGE_ROWS and scale < RANGES**4):
        inside = turns if edge is None else turns.filter(F.floor(F.col("finish") * scale) == edge)
        scale *= RANGES
        sums = sorted(inside.groupBy(F.floor(F.col("finish") * scale).cast("long").alias("range")).agg(F.sum(words).alias("sum"), F.count("*").alias("n")).collect())
        edge = None
        for r in sums:
            if r["sum"] > left:
                edge, rows_in = r["range"], r["n"]
                break
            left -= r["sum"]
    key = ["finish", "rank", "hash", "doc_id", "size"]
    if edge is None:
        cut = None
    else:
        last = turns.filter(F.floor(F.col("finish") * scale) == edge).withColumn("spent", F.sum(words).over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)))
        last = last.filter(F.col("spent") <= left).orderBy(*[F.desc(k) for k in key]).limit(1).collect()
        cut = last[0] if last else Row(finish=edge / scale, rank=-1, hash=0, doc_id=None, size=-1)

    def in_mix(f):
        if cut is None:
            return F.coalesce(f < 2, F.lit(False))
        # ties after the cut's finish time go by source, place in the queue, id and size
        tie = (F.col("rank") < cut["rank"]) | ((F.col("rank") == cut["rank"]) & (F.struct("hash", "doc_id", "size") <= F.struct(F.lit(cut["hash"]).cast("long"), F.lit(cut["doc_id"]).cast(queue.schema["doc_id"].dataType), F.lit(cut["size"]).cast("long"))))
        return F.coalesce((f < F.lit(cut["finish"])) | ((f == F.lit(cut["finish"])) & tie), F.lit(False))

    taken = sum((F.when(in_mix(f), F.col("size")).otherwise(0) for f in finish), F.lit(0)).cast("long")
    return queue.select("doc_id", "source", "copies", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with all their columns; one that is taken k times has k rows."""
    times = mix(docs, **options).filter(F.col("taken") > 0).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    size = F.regexp_count("text", F.lit(common.WORD)).cast("long")
    joined = docs.join(times, docs.doc_id.eqNullSafe(F.col("__id")) & docs.source.eqNullSafe(F.col("__source")) & (size == F.col("__size")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    taken = mix(common.read_table(spark, sf_dir, "documents"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "size", "source_size", "target", "taken")
