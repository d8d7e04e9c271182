"""Exact top-k inner products by block-at-a-time pruning.

The terms are the vector's components. Documents stand in blocks of a range of a
packed order; a block keeps each term's largest and smallest value, whose sum of
products with a query bounds every score in the block from above. A query takes
the blocks in order of that bound, scores each through the block's forward
index, and stops when the next bound is below its kth score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

#: Documents in a block, and queries in a packed row.
BLOCK, QUERIES = 128, 512
_EXACT = 2.0**53


def quantized(x: np.ndarray) -> np.ndarray:
    """floor(256 * x); components near the end of a double's range go through wider numbers, so none becomes infinite."""
    with np.errstate(over="ignore"):
        out = np.floor(256.0 * x)
    return out if np.isfinite(out).all() else np.floor(np.longdouble(256) * x.astype(np.longdouble))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in Python's integers, held to a long's range."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def block_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int, size: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best documents here, own id excluded; missing ones are masked among the ids.

    Scores descend, ties go to the smaller id. floor: a score of each query below which nothing is looked for, such as its
    kth over other documents; documents below it may be missing.
    """
    n, m = len(queries), len(docs)
    # ids count as their place among the distinct ones, so that -1 is an empty place whatever the ids are
    names, ids = np.unique(ids, return_inverse=True)
    at = np.minimum(np.searchsorted(names, query_ids), len(names) - 1)
    query_ids = np.where(names[at] == query_ids, at, -2)
    # documents of one leading term stand together, which keeps the blocks' bounds tight
    lead = np.argmax(np.abs(docs), axis=1) if docs.shape[1] else np.zeros(m, np.int64)
    order = np.lexsort((docs[np.arange(m), lead] if docs.shape[1] else lead, lead))
    ids, docs = ids[order], docs[order]
    starts = np.arange(0, m, size)
    top, low = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    bounds = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    if np.abs(bounds).max(initial=0) >= _EXACT / 4:
        bounds = bounds + np.abs(bounds) * 1e-9 + 1
    visit = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((n, k), np.iinfo(np.int64).min)
    best_ids = np.full((n, k), -1)
    alive = np.arange(n)
    near = 2 * k if len(names) == m else m + k  # with repeated ids any number of scores may count once
    for turn in range(len(starts)):
        block = visit[alive, turn]
        full = best_ids[alive, k - 1] >= 0
        keep = ~full | (bounds[alive, block] >= best[alive, k - 1].astype(np.float64))
        if floor is not None:
            keep &= bounds[alive, block] >= floor[alive]
        alive, block = alive[keep], block[keep]
        if not len(alive):
            break
        for b in np.unique(block):
            q = alive[block == b]
            some = slice(starts[b], starts[b] + size)
            score, who = inner(queries[q], docs[some]), np.broadcast_to(ids[some], (len(q), len(ids[some])))
            own = who == query_ids[q][:, None]
            score = np.where(own, np.iinfo(np.int64).min, score)
            who = np.where(own, -1, who)
            score, who = np.concatenate([best[q], score], 1), np.concatenate([best_ids[q], who], 1)
            best[q], best_ids[q] = _ranked(score, who, k, near)
    return best, np.ma.array(names[best_ids], mask=best_ids < 0)


def joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two results of `block_search` for the same queries."""
    score, who = np.concatenate([a[0], b[0]], 1), np.ma.concatenate([a[1], b[1]], 1)
    real = ~np.ma.getmaskarray(who)
    names, place = np.unique(who.data[real], return_inverse=True)
    if not len(names):
        return a
    at = np.full(who.shape, -1)
    at[real] = place
    # an id is at most once on either side
    best, at = _ranked(np.where(real, score, np.iinfo(np.int64).min), at, k, 2 * k)
    return best, np.ma.array(names[at], mask=at < 0)


def kth(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each query's kth score, below all others where it has fewer."""
    return np.where(np.ma.getmaskarray(found[1])[:, -1], -np.inf, found[0][:, -1].astype(np.float64))


def _ranked(score: np.ndarray, who: np.ndarray, k: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each row, each id once; `near`: among how many best scores k ids are sure to be."""
    n = len(score)
    row = np.repeat(np.arange(n), score.shape[1])
    s, w = score.ravel(), who.ravel()
    real = w >= 0
    near = min(near, score.shape[1])
    floor = np.partition(np.where(who >= 0, score, np.iinfo(np.int64).min), -near, axis=1)[:, -near]
    keep = real & (s >= floor[row])
    row, s, w = row[keep], s[keep], w[keep]
    order = np.lexsort((w, ~s, row))
    row, s, w = row[order], s[order], w[order]
    # repeated ids: equal ids of a query side by side after a second sort, the first (best) stays
    by_id = np.lexsort((np.arange(len(w)), w, row))
    again = np.zeros(len(w), bool)
    again[by_id[1:]] = (row[by_id[1:]] == row[by_id[:-1]]) & (w[by_id[1:]] == w[by_id[:-1]])
    row, s, w = row[~again], s[~again], w[~again]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    ok = place < k
    out, ids = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), -1)
    out[row[ok], place[ok]], ids[row[ok], place[ok]] = s[ok], w[ok]
    return out, ids


def _packs(limit: int):
    def run(batches):
        for ids, x in vectors.matrices(batches):
            for at in range(0, len(ids), limit):
                part = x[at : at + limit]
                yield pa.record_batch([pa.array([x.shape[1]], pa.int64()), pa.array([ids[at : at + limit].astype(np.int64).tobytes()]), pa.array([np.ascontiguousarray(part).tobytes()])], ["dim", "ids", "matrix"])

    return run


def top_inner_products(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k largest integer inner products over all usable rows of `data` but those with its own vec_id.

    Both are (vec_id, v) as `vectors.usable` gives them; components count as floor(256 * x). Vectors of another length
    than the query's take no part; repeated vec_ids count once, with their best score. Sums are exact; one beyond a long's
    range, which no long can say, counts as the nearest long.
    """
    spark = data.sparkSession
    schema = "dim long, ids binary, matrix binary"
    packs = data.mapInArrow(_packs(vectors.PACK), schema)
    asks = queries.coalesce(max(1, common.parts(spark) // 4)).mapInArrow(_packs(QUERIES), schema)
    groups = max(2, common.parts(spark))
    packs = packs.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asks = asks.select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("tile"))

    def score(frames):
        # packs of documents that meet the same queries follow one another: these keep their best from pack to pack
        held, q_ids, q, best = None, None, None, None

        def rows():
            some = ~np.ma.getmaskarray(best[1])
            return pd.DataFrame({"query_id": np.repeat(q_ids, k)[some.ravel()], "vec_id": best[1].data[some], "score": best[0][some]})

        for frame in frames:
            for r in frame.itertuples():
                if held != (r.dim, r.q_ids, r.q_matrix):
                    if held is not None:
                        yield rows()
                    held, best = (r.dim, r.q_ids, r.q_matrix), None
                    q_ids = np.frombuffer(r.q_ids, np.int64)
                    q = quantized(np.frombuffer(r.q_matrix, np.float64).reshape(len(q_ids), r.dim))
                ids = np.frombuffer(r.ids, np.int64)
                got = block_search(q_ids, q, ids, quantized(np.frombuffer(r.matrix, np.float64).reshape(len(ids), r.dim)), k, floor=None if best is None else kth(best))
                best = got if best is None else joined(best, got, k)
        if held is not None:
            yield rows()

    # a merge join takes its left rows one by one, each with all packs of its tile
    found = asks.join(packs.hint("merge"), ["dim", "tile"]).select("dim", "ids", "matrix", "q_ids", "q_matrix").mapInPandas(score, "query_id long, vec_id long, score long")
    return vectors.nearest_of_each(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, F.desc("score"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    rows = vectors.usable(common.read_table(spark, sf_dir, "embeddings"))
    return top_inner_products(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
