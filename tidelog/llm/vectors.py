"""Vector columns as matrices, for the two vector searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in one packed row at most.
PACK = 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: neither id nor vector null, no component null or non-finite."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.filter(~bad)


def matrices(batches):
    """(ids, matrix) of each length of vector in each batch of (vec_id, v)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("v")
        offsets = np.asarray(column.offsets)
        values = np.asarray(column.values).astype(np.float64, copy=False)
        ids, lengths = np.asarray(batch.column("vec_id")), np.diff(offsets)
        for n in np.unique(lengths):
            some = np.flatnonzero(lengths == n)
            yield ids[some], values[(offsets[some][:, None] + np.arange(n)).ravel()].reshape(len(some), n)


def nearest_of_each(found: DataFrame, k: int, best_first) -> DataFrame:
    """The k best distinct vec_ids of each query by `best_first`, ties to the smaller vec_id, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def frame_of(queries: list, ids: list, scores: list, kind) -> pd.DataFrame:
    if not queries:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, kind)})
    return pd.DataFrame({"query_id": np.concatenate(queries), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})


