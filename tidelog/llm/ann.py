"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector with `bits` functions floor((a . x + b) / width), a
Gaussian. A query visits perturbed buckets in order of the probability that a
neighbour at the expected distance falls there, until these probabilities sum to
what each table needs for the wanted recall. Every vector is in every table;
candidates of a bucket are ranked by exact distance where they lie, and the
tables' best are merged. A query whose kth distance is beyond the expected one
probes again for that distance; one that found fewer than k, or whose distance
is far beyond, is ranked against all rows in blocks.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

#: Rows that the widths and the expected neighbour distance are fitted on, at most.
SAMPLE = 2000
#: Tables, hash width in standard deviations of a projection, rows a bucket should hold, wanted recall.
TABLES, WIDTH, BUCKET_ROWS, RECALL = 3, 1.3, 1500, 0.97
#: Vectors compared at once, and queries whose best a task holds before it hands them on.
BLOCK, HELD = 2048, 100_000
#: Expected distances up to which a query probes again; beyond that all rows are cheaper than the buckets.
FAR = 1.5


class Hashes:
    """The hash functions of all tables for vectors of one length."""

    def __init__(self, dim: int, bits: int, spread: float, tables: int = TABLES, seed: int = 5):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.bits, self.tables = dim, bits, tables
        self.width = WIDTH * spread or 1.0
        self.a = rng.standard_normal((tables * bits, dim))
        self.b = rng.uniform(0, self.width, tables * bits)

    def places(self, x: np.ndarray) -> np.ndarray:
        """(a . x + b) / width, by vector, table and function."""
        return ((x @ self.a.T + self.b) / self.width).reshape(len(x), self.tables, self.bits)

    def keys(self, slots: np.ndarray, table: np.ndarray) -> np.ndarray:
        """A 64-bit key of a bucket; slots end in the axis of functions."""
        key = np.full(slots.shape[:-1], self.dim, np.uint64) * np.uint64(1000003) + table.astype(np.uint64)
        for i in range(self.bits):
            key = common.mix64(key + slots[..., i].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
        return key.astype(np.int64)


def _cdf(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def probes(place: np.ndarray, distance: float, wanted: float) -> list[tuple[int, ...]]:
    """Slots of one table for one query, best first, until a neighbour is in one of them with probability `wanted`.

    place: the query's places in the table; distance: of a neighbour, in widths.
    """
    choices = []
    for x in place:
        base = math.floor(x)
        reach = 1 + math.ceil(3 * distance)
        chance = [(_cdf((s + 1 - x) / distance) - _cdf((s - x) / distance), s) for s in range(base - reach, base + reach + 1)]
        choices.append(sorted(((p, s) for p, s in chance if p > 1e-6), reverse=True))
    first = (0,) * len(choices)
    score = lambda at: math.prod(c[i][0] for c, i in zip(choices, at))
    heap, seen, out, sum_ = [(-score(first), first)], {first}, [], 0.0
    while heap and sum_ < wanted:
        p, at = heapq.heappop(heap)
        sum_ -= p
        out.append(tuple(c[i][1] for c, i in zip(choices, at)))
        for i in range(len(at)):
            if at[i] + 1 < len(choices[i]):
                more = (*at[:i], at[i] + 1, *at[i + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (-score(more), more))
    return out


def _collapsed(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that k + 1 equal vectors of smaller ids precede: these can be among no query's k nearest."""
    order = np.lexsort((ids, *x.T[::-1])) if x.shape[1] else np.argsort(ids)
    s, i = x[order], ids[order]
    again = np.concatenate([[False], (s[1:] == s[:-1]).all(1) & (i[1:] == i[:-1])]) if len(s) else np.zeros(0, bool)
    s, i = s[~again], i[~again]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)]) if len(s) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    place = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    return i[place <= k], s[place <= k]


class Best:
    """The k nearest rows of each query that a task has seen, each id once."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def see(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Rank the rows of a bucket by exact distance. A product of matrices, with room for its rounding, only leaves out what cannot be near enough."""
        kth = np.array([d[-1] if len(d) == self.k else np.inf for d, _ in (self.of.get(i, ((), ())) for i in q_ids.tolist())])
        q2, x2 = (q**2).sum(1), (x**2).sum(1)
        squared = q2[:, None] + x2 - 2 * (q @ x.T)
        room = 1e-9 * (q2 + x2.max(initial=0) + 1e-300)
        limit = kth**2
        if len(x) > self.k + 1:
            limit = np.minimum(limit, np.partition(squared, self.k, axis=1)[:, self.k])  # one more than k: the query itself may be among them
        a, b = np.nonzero(squared <= (limit + 2 * room)[:, None])
        keep = q_ids[a] != ids[b]
        a, b = a[keep], b[keep]
        d = np.sqrt(((x[b] - q[a]) ** 2).sum(axis=1))
        order = np.lexsort((ids[b], d, a))
        a, b, d = a[order], ids[b][order], d[order]
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
        for s, e in zip(starts, [*starts[1:], len(a)]):
            i = int(q_ids[a[s]])
            old = self.of.get(i)
            dd, ii = (d[s:e], b[s:e]) if old is None else (np.concatenate([old[0], d[s:e]]), np.concatenate([old[1], b[s:e]]))
            by = np.lexsort((ii, dd))
            dd, ii = dd[by], ii[by]
            _, first = np.unique(ii, return_index=True)
            first = np.sort(first)[: self.k]
            self.of[i] = (dd[first], ii[first])

    def rows(self) -> pd.DataFrame:
        out = vectors.frame_of([np.full(len(d), i) for i, (d, _) in self.of.items()], [i for _, i in self.of.values()], [d for d, _ in self.of.values()], np.float64)
        self.of = {}
        return out


_SCHEMA = "key long, dim long, ids binary, matrix binary"


def _packed(keys: np.ndarray, ids: np.ndarray, x: np.ndarray, limit: int):
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        for at in range(a, b, limit):
            some = order[at : min(b, at + limit)]
            yield (int(keys[order[a]]), x.shape[1], ids[some].astype(np.int64).tobytes(), np.ascontiguousarray(x[some]).tobytes())


def _batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "dim", "ids", "matrix"])


_FOUND = "query_id long, vec_id long, score double"


def _ranking(k: int):
    def rank(frames):
        best = Best(k)
        for frame in frames:
            for r in frame.itertuples():
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                best.see(np.frombuffer(r.q_matrix).reshape(len(q_ids), r.dim), q_ids, np.frombuffer(r.matrix).reshape(len(ids), r.dim), ids)
            if len(best.of) > HELD:
                yield best.rows()
        yield best.rows()

    return rank


class Index:
    """Fitted on at most `sample` rows of (vec_id, v): the spread of projections and the distance of neighbours, per length of vector."""

    def __init__(self, rows: DataFrame, k: int = 10, sample: int = SAMPLE, recall: float = RECALL):
        self.rows, self.k = rows, k
        self.wanted = 1 - (1 - recall) ** (1 / TABLES)
        count = rows.count()
        share = min(1.0, 1.2 * sample / max(1, count))
        taken = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("v").limit(sample).collect()
        bits = max(2, round(math.log(max(2, count / BUCKET_ROWS)) / math.log(2.6)))
        by: dict[int, list] = {}
        for r in taken:
            by.setdefault(len(r["v"]), []).append(r["v"])
        self.tables: dict[int, tuple[Hashes, float]] = {}
        for dim, some in by.items():
            x = np.array(some, np.float64).reshape(len(some), dim)
            spread = float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())) or 1.0
            near = [np.partition(d[d > 0], min(k, (d > 0).sum() - 1))[min(k, (d > 0).sum() - 1)] for v in x[:200] if ((d := np.sqrt(((x - v) ** 2).sum(1))) > 0).any()]
            self.tables[dim] = (Hashes(dim, bits, spread), float(np.median(near)) if near else spread)
        self.bits = bits

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score): each query's k nearest found, all rows of its length if fewer, ties to the smaller vec_id, own id excluded."""
        k = self.k
        near = F.coalesce(*[F.when(F.size("v") == dim, F.lit(d)) for dim, (_, d) in self.tables.items()], F.lit(1.0))
        first = common.stored(self._nearest(self._probed(queries.withColumn("reach", near))))
        have = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"), F.max("score").alias("kth"))
        weak = queries.withColumn("near", near).join(have, "vec_id", "left").filter(F.col("found").isNull() | (F.col("found") < k) | (F.col("kth") > F.col("near")))
        weak = common.stored(weak.select("vec_id", "v", F.when((F.col("found") >= k) & (F.col("kth") <= FAR * F.col("near")), F.col("kth")).alias("reach")))
        again, rest = weak.filter(F.col("reach").isNotNull()), weak.filter(F.col("reach").isNull()).select("vec_id", "v")
        found = [first.select("query_id", "vec_id", "score")]
        found += [self._probed(again)] if not again.isEmpty() else []
        found += [self._ranked_all(rest)] if not rest.isEmpty() else []
        if len(found) == 1:
            return first
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return self._nearest(out)

    def _nearest(self, found: DataFrame) -> DataFrame:
        return vectors.nearest_of_each(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), self.k, F.asc("score"))

    def _probed(self, queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the best in the buckets where a neighbour of (vec_id, v, reach) at the distance `reach` may be."""
        k, tables, bits, wanted = self.k, self.tables, self.bits, self.wanted

        def table(dim: int) -> Hashes:
            """Lengths that the sample has none of get unit spread."""
            if dim not in tables:
                tables[dim] = (Hashes(dim, bits, 1.0), 1.0)
            return tables[dim][0]

        def index(batches):
            for ids, x in vectors.matrices(batches):
                for at in range(0, len(ids), vectors.PACK):
                    i, v = _collapsed(ids[at : at + vectors.PACK], x[at : at + vectors.PACK], k)
                    hashes = table(x.shape[1])
                    slots = np.floor(hashes.places(v))
                    for t in range(hashes.tables):
                        yield _batch(list(_packed(hashes.keys(slots[:, t], np.full(len(v), t)), i, v, BLOCK)))

        def ask(batches):
            for ids, x in vectors.matrices(batches):
                x, reach = x[:, :-1], x[:, -1]
                hashes = table(x.shape[1])
                places = hashes.places(x)
                for t in range(hashes.tables):
                    # a neighbour's projection differs by a Gaussian of its distance
                    found = [probes(p, d / hashes.width, wanted) for p, d in zip(places[:, t], reach)]
                    own = np.repeat(np.arange(len(x)), [len(f) for f in found])
                    slots = np.array([s for f in found for s in f], np.float64).reshape(len(own), hashes.bits)
                    yield _batch(list(_packed(hashes.keys(slots, np.full(len(own), t)), ids[own], x[own], 256)))

        asks = queries.select("vec_id", F.concat("v", F.array("reach")).alias("v"))
        asks = asks.coalesce(max(1, common.parts(queries.sparkSession) // 4)).mapInArrow(ask, _SCHEMA)
        asks = asks.select("key", "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        pairs = self.rows.mapInArrow(index, _SCHEMA).join(asks, ["key", "dim"]).select("dim", "ids", "matrix", "q_ids", "q_matrix")
        return pairs.mapInPandas(_ranking(k), _FOUND)

    def _ranked_all(self, queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the best of all rows, in blocks dealt out over tiles; every query goes to every tile."""
        k, tiles = self.k, max(2, common.parts(queries.sparkSession))

        def blocks(batches):
            for ids, x in vectors.matrices(batches):
                for at in range(0, len(ids), BLOCK):
                    i, v = _collapsed(ids[at : at + BLOCK], x[at : at + BLOCK], k)
                    yield _batch(list(_packed(np.full(len(i), int(common.mix64(i[:1].astype(np.uint64))[0]) % tiles), i, v, BLOCK)))

        def ask(batches):
            for ids, x in vectors.matrices(batches):
                yield _batch(list(_packed(np.zeros(len(ids), np.int64), ids, x, 256)))

        asks = queries.coalesce(max(1, common.parts(queries.sparkSession) // 4)).mapInArrow(ask, _SCHEMA)
        asks = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("key"), "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        pairs = self.rows.mapInArrow(blocks, _SCHEMA).join(asks, ["key", "dim"]).select("dim", "ids", "matrix", "q_ids", "q_matrix")
        return pairs.mapInPandas(_ranking(k), _FOUND)


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    rows = vectors.usable(common.read_table(spark, sf_dir, "embeddings"))
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    return Index(rows).search(rows.filter(F.col("vec_id") % 100 == 0))
