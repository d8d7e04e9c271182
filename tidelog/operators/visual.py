"""Grids, hashes and entropy of frames, and the runs they form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence

#: A cell has changed from this difference on; a frame from this share of cells on; layout, freeze and blank thresholds.
CELL_DELTA, MIN_CHANGE, LAYOUT_CHANGE, FREEZE_MS = 8, 0.008, 0.35, 5000


def hash_bits(hex16: Column) -> Column:
    """Sixteen hex digits as a signed long."""
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Unequal bits of two 64-bit hashes in hex; 64 where they cannot be compared."""
    fit = (F.length(a) == 16) & (F.length(b) == 16)
    return F.coalesce(F.when(fit, F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))), F.lit(64))


def sign_hash(values: Column) -> Column:
    """64 sign bits of a list of numbers as a long."""
    return F.aggregate(F.slice(values, 1, 64), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def grid_diff(previous: Column, current: Column, delta: float = CELL_DELTA) -> Column:
    """Share of changed cells (4 places), mean and largest difference of two equally long grids; null where they are not."""
    apart = F.zip_with(previous, current, lambda a, b: F.abs(a - b))
    n = F.size(previous)
    fit = (n == F.size(current)) & (n > 0)
    changed = F.size(F.filter(apart, lambda x: x >= delta))
    total = F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(fit, F.struct(F.round(changed / n, 4).alias("change_score"), F.round(total / n, 4).alias("mean_abs"), F.round(F.array_max(apart).cast("double"), 4).alias("max_abs"), changed.alias("n_changed")))


def change_box(previous: Column, current: Column, columns: int, rows: int, width: Column, height: Column, delta: float = CELL_DELTA) -> Column:
    """(x, y, w, h) in pixels of the envelope of changed cells, by a grid of columns x rows over an image; null where nothing has changed."""
    cells = F.filter(F.transform(F.zip_with(previous, current, lambda a, b: F.abs(a - b) >= delta), lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())
    x, y = F.transform(cells, lambda i: i % columns), F.transform(cells, lambda i: F.floor(i / columns))
    left, top = F.floor(F.array_min(x) * width / columns), F.floor(F.array_min(y) * height / rows)
    right, bottom = F.least(width, F.ceil((F.array_max(x) + 1) * width / columns)), F.least(height, F.ceil((F.array_max(y) + 1) * height / rows))
    return F.when((F.size(previous) == F.size(current)) & (F.size(cells) > 0), F.struct(left.cast("long").alias("x"), top.cast("long").alias("y"), (right - left).cast("long").alias("w"), (bottom - top).cast("long").alias("h")))


def visual_events(frames: DataFrame, by: list[str], ts: str, score: str, blank: str, error_text: str, least_ms: int = FREEZE_MS) -> DataFrame:
    """(by, kind, start_ms, end_ms, frames): freezes of least_ms or more, blank screens, layout changes and errors on the screen; repeats of one kind in a row are one event."""
    frozen_ = frozen(frames, by, ts, score, least_ms).select(*by, F.lit("freeze").alias("kind"), "start_ms", "end_ms", "frames")
    kind = F.when(F.col(error_text), "screen_error").when(F.col(blank), "blank").when(F.col(score) >= LAYOUT_CHANGE, "layout_change").otherwise("")
    runs = sequence.run_lengths(frames.withColumn("kind", kind), by, [ts], "kind").filter(F.col("kind") != "")
    return frozen_.unionByName(runs.select(*by, "kind", F.col("first").alias("start_ms"), F.col("last").alias("end_ms"), F.col("repeat").alias("frames")))


def entropy(histogram: Column) -> Column:
    """Bits of a list of counts."""
    total = F.aggregate(histogram, F.lit(0.0), lambda acc, x: acc + x)
    return F.aggregate(histogram, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def text_entropy(text: Column) -> Column:
    """Bits a character of a text, from its characters' counts; 0 for an empty one. Arrow batches, as no built-in function counts characters within a row."""

    def bits(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            if t is None:
                return None
            p = np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32), return_counts=True)[1] / max(1, len(t))
            return float(-(p * np.log2(p)).sum()) + 0.0

        return texts.map(one).astype("float64")

    return F.pandas_udf(bits, "double")(text)


def change_class(score: Column) -> Column:
    return F.when(score == 0, "identical").when(score < MIN_CHANGE, "minor_change").when(score >= LAYOUT_CHANGE, "layout_change").otherwise("changed")


def change_runs(frames: DataFrame, by: list[str], order: list[str], score: str) -> DataFrame:
    """Runs of identical or of minor changes collapse into one row each; larger changes stay rows of their own."""
    classed = frames.withColumn("change", change_class(F.col(score)))
    same = (F.col("change") == sequence.before("change", by, order)) & F.col("change").isin("identical", "minor_change")
    runs = sequence.islands(classed, by, order, same)
    return runs.groupBy(*by, "island").agg(F.first("change").alias("change"), F.min(order[0]).alias("first_seq"), F.max(order[0]).alias("last_seq"), F.count("*").alias("frames"))


def frozen(frames: DataFrame, by: list[str], ts: str, score: str, least_ms: int = FREEZE_MS) -> DataFrame:
    """Unchanged stretches of least_ms or more, with frames and duration."""
    runs = sequence.islands(frames, by, [ts], F.col(score) < MIN_CHANGE)
    out = runs.groupBy(*by, "island").agg(F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.count("*").alias("frames"))
    return out.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
