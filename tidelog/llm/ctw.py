"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, top bit first, so each context (the last d
bytes, d = 0 to `depth`) has 255 decision nodes with a count of zeros and ones.
Each node's Krichevsky-Trofimov block probability Pe is weighted against its
children's: Pw = Pe / 2 + prod(Pw of children) / 2. A text is scored with the
tree of the training texts, held fixed: at each decision the estimates of all
depths that training has seen are mixed by the weights Pe / 2 / Pw along the
path, and the sum over bytes is the text's code length.

Nothing that grows with the corpus is broadcast. Slices of documents ask buckets
of contexts for the code lengths of their distinct (depth + 1)-byte strings;
buckets hold whole subtrees below two bytes of context, and only nodes above,
at most 65,793 contexts of 255 nodes, meet on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pack

DEPTH = 5
#: The byte that ends a text; words contain none, and it also stands before the first byte.
END = 0x0A
#: Stands among word hashes for the token that ends each text.
END_WORD = np.uint64(1)
#: Raw bytes of documents a bucket stands for, slices whose counts one task adds, and bytes of questions that are worth a copy of a bucket's model, which may be larger itself.
BUCKET_BYTES, SERVED, COPY_BYTES = 1 << 23, 256, 1 << 24
#: Code lengths travel as multiples of this.
UNIT = 2.0**-40
#: Bytes of text in a slice; larger ones ask for fewer strings in all.
SLICE = 3 << 20
_HALF = -math.log(2)


def normalized(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text in lower case (A-Z), its words joined by one space, then the end byte."""
    low = common.LOWER[data].tobytes()
    return [b" ".join(low[a:b].split()) + b"\n" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text a key: its context with the nearest byte on top, then the byte; and the text's index."""
    data = np.frombuffer(b"".join([bytes([END]) * depth + t for t in texts]), np.uint8).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    n = len(data) - depth
    keys = data[depth - 1 : depth - 1 + n] if depth else np.zeros(n, np.uint64)
    for d in range(2, depth + 1):
        keys = (keys << np.uint64(8)) | data[depth - d : depth - d + n]
    keys = (keys << np.uint64(8)) | data[depth:]
    own = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(own)) + own * depth
    return keys[at], own


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and END_WORD for each end, and the text's index."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = common.words(data, offsets)
    hashes = common.range_hash(common.prefix_hash(data), starts, ends) | np.uint64(2)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    return np.concatenate([hashes, np.full(len(texts), END_WORD)]), np.concatenate([own, np.arange(len(texts))])


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, weights.dtype)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma_half(zeros) + _lgamma_half(ones) - _lgamma_one(zeros + ones)


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2) / Gamma(1/2))."""
    x = n + 0.5
    return np.where(n < len(_HALVES), _HALVES[np.minimum(n, len(_HALVES) - 1)], _stirling(x) - 0.5 * math.log(math.pi))


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    """log(n!)."""
    return np.where(n < len(_WHOLES), _WHOLES[np.minimum(n, len(_WHOLES) - 1)], _stirling(n + 1.0))


def _stirling(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1.0)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_HALVES = np.array([math.lgamma(n + 0.5) for n in range(4096)]) - 0.5 * math.log(math.pi)
_WHOLES = np.array([math.lgamma(n + 1) for n in range(4096)])


def _nodes(keys: np.ndarray, counts: np.ndarray, drop: int, bit: int):
    """Decision nodes of contexts without their `drop` farthest bytes: (context << 8 | byte's top bits), zeros, ones."""
    context = (keys >> np.uint64(8 + 8 * drop)) << np.uint64(8)
    byte = keys & np.uint64(255)
    node = context | (byte >> np.uint64(8 - bit))
    one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
    order = np.argsort(node, kind="stable")
    node, n, n1 = node[order], counts[order], (counts * one)[order]
    at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    if not len(at):
        return node, np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, ones = np.add.reduceat(n, at), np.add.reduceat(n1, at)
    return node[at], total - ones, ones


class Tree:
    """The weighted nodes of depths `top` to `depth` over the given training strings; counts are above 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int, below: dict | None = None):
        """below: at bit, (node keys at depth + 1, log Pw), when the deepest level here has children elsewhere."""
        self.depth, self.top = depth, top
        self.levels: dict[tuple[int, int], tuple] = {}
        for bit in range(8):
            child = below[bit] if below else None
            for d in range(depth, top - 1, -1):
                node, zeros, ones = _nodes(keys, counts, depth - d, bit)
                log_e = _log_kt(zeros, ones)
                if child is None:
                    log_w, stop = log_e, np.ones(len(node))
                else:
                    up = (child[0] >> np.uint64(16) << np.uint64(8)) | (child[0] & np.uint64(255))
                    split = np.bincount(np.searchsorted(node, up), child[1], len(node))
                    log_w = np.logaddexp(_HALF + log_e, _HALF + split)
                    stop = np.exp(_HALF + log_e - log_w)
                self.levels[d, bit] = (node, (ones + 0.5) / (zeros + ones + 1.0), stop, log_w)
                child = (node, log_w)

    def mixed(self, keys: np.ndarray, bit: int, start: np.ndarray | None = None) -> np.ndarray:
        """Walk up from the deepest seen context: P(one) at this bit, NaN where no depth has been seen. start: what deeper levels say."""
        p = np.full(len(keys), np.nan) if start is None else start
        byte = keys & np.uint64(255)
        for d in range(self.depth, self.top - 1, -1):
            node, kt, stop, _ = self.levels[d, bit]
            if not len(node):
                continue
            want = ((keys >> np.uint64(8 + 8 * (self.depth - d))) << np.uint64(8)) | (byte >> np.uint64(8 - bit))
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            seen = node[at] == want
            here = np.where(np.isnan(p), kt[at], stop[at] * kt[at] + (1 - stop[at]) * p)
            p = np.where(seen, here, p)
        return p


def code_lengths(keys: np.ndarray, low: Tree, high: Tree) -> np.ndarray:
    """log10 of the probability of each key's byte in its context. low: depths 2 and on; high: depths 0 and 1."""
    out = np.zeros(len(keys))
    shift = np.uint64(8 * (low.depth - high.depth))
    above = ((keys >> np.uint64(8)) >> shift << np.uint64(8)) | (keys & np.uint64(255))
    for bit in range(8):
        p = high.mixed(above, bit, low.mixed(keys, bit))
        p = np.where(np.isnan(p), 0.5, p)
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(one, p, 1 - p))
    return out


def _bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """By the two nearest bytes of the context."""
    return (common.mix64(keys >> np.uint64(8 * (depth - 1))) % np.uint64(buckets)).astype(np.int64)


def _ask(depth: int, buckets: int):
    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                texts = normalized(*pack.unpacked(r.texts, r.lengths))
                train = np.asarray(r.flags, bool)
                rows = {}
                for kind, (keys, own) in (("g", strings(texts, depth)), ("w", word_keys(texts))):
                    learned, counts = grouped(keys[train[own]], np.ones(int(train[own].sum()), np.int64))
                    keys = np.unique(keys)
                    n = np.zeros(len(keys), np.uint32)
                    n[np.searchsorted(keys, learned)] = counts
                    b = _bucket(keys, depth, buckets) if kind == "g" else (keys % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(b, kind="stable")
                    at = np.searchsorted(b[order], np.arange(buckets + 1))
                    for i in range(buckets):
                        some = order[at[i] : at[i + 1]]
                        rows.setdefault(i, {})[kind] = (pack.put_keys(keys[some]), pack.put(n[some]))
                yield pd.DataFrame([(i, r.slice, *x["g"], *x["w"]) for i, x in rows.items()], columns=["bucket", "slice", "g", "gn", "w", "wn"])

    return run


def _merge(frame: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for kind in "gw":
        keys = np.concatenate([pack.get_keys(b) for b in frame[kind]])
        counts = np.concatenate([pack.get(b, np.uint32) for b in frame[f"{kind}n"]]).astype(np.int64)
        some = counts > 0
        out[kind] = grouped(keys[some], counts[some])
    return out


def _partial(key, frame: pd.DataFrame) -> pd.DataFrame:
    x = _merge(frame)
    return pd.DataFrame([(key[0], pack.put_keys(x["g"][0]), pack.put(x["g"][1].astype(np.uint64)), pack.put_keys(x["w"][0]), pack.put(x["w"][1].astype(np.uint64)))], columns=["bucket", "g", "gn", "w", "wn"])


def _learned(frame: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {k: grouped(np.concatenate([pack.get_keys(b) for b in frame[k]]), np.concatenate([pack.get(b, np.uint64) for b in frame[f"{k}n"]]).astype(np.int64)) for k in "gw"}


def _model(depth: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        x = _learned(frame)
        (g, gn), (w, wn) = x["g"], x["w"]
        low = Tree(g, gn, depth, 2)
        tops = [pack.put_keys(low.levels[2, bit][0]) for bit in range(8)]
        weights = [pack.put(low.levels[2, bit][3]) for bit in range(8)]
        g2, n2 = grouped(((g >> np.uint64(8)) >> np.uint64(8 * (depth - 2)) << np.uint64(8)) | (g & np.uint64(255)), gn)
        return pd.DataFrame([(key[0], pack.put_keys(g), pack.put(gn.astype(np.uint64)), pack.put_keys(w), pack.put(wn.astype(np.uint64)), pack.put_keys(g2), pack.put(n2), tops, weights, len(w), int(wn.sum()))], columns=["bucket", "g", "gn", "w", "wn", "g2", "n2", "tops", "weights", "vocabulary", "tokens"])

    return run


def upper_tree(rows) -> Tree:
    """Depths 0 and 1 from every bucket's strings of two context bytes and node weights at depth 2."""
    g = np.concatenate([pack.get_keys(r["g2"]) for r in rows]) if rows else np.zeros(0, np.uint64)
    n = np.concatenate([pack.get(r["n2"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    below = {}
    for bit in range(8):
        keys = np.concatenate([pack.get_keys(r["tops"][bit]) for r in rows]) if rows else np.zeros(0, np.uint64)
        below[bit] = (keys, np.concatenate([pack.get(r["weights"][bit], np.float64) for r in rows]) if rows else np.zeros(0))
    keys, counts = grouped((g >> np.uint64(16) << np.uint64(8)) | (g & np.uint64(255)), n)
    return Tree(keys, counts, 1, 0, below)


def score_documents(docs: DataFrame, train, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every whole text; `train` is the boolean column that says which texts teach.

    A null or empty text has the end token alone. Repeated rows teach and are scored each. Without training texts every decision has probability 1/2 and every word count is 0.
    depth: bytes of context, 2 to 7.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    slices = pack.packed_documents(docs, SLICE, train)
    size = slices.agg(F.sum("raw").alias("raw"), F.count("*").alias("n")).first()
    buckets = int(min(4096, max(4, -(-(size["raw"] or 0) // BUCKET_BYTES))))
    salts = max(1, -(-size["n"] // SERVED))
    asked = common.stored(slices.mapInPandas(_ask(depth, buckets), "bucket long, slice long, g binary, gn binary, w binary, wn binary"))
    partial = common.stored(asked.groupBy("bucket", F.pmod("slice", F.lit(salts)).alias("salt")).applyInPandas(_partial, "bucket long, g binary, gn binary, w binary, wn binary"))
    common.release()
    model = common.stored(partial.groupBy("bucket").applyInPandas(_model(depth), "bucket long, g binary, gn binary, w binary, wn binary, g2 binary, n2 binary, tops array<binary>, weights array<binary>, vocabulary long, tokens long"))
    common.release(partial)
    rows = model.select("g2", "n2", "tops", "weights", "vocabulary", "tokens").collect()
    high, total, vocabulary = upper_tree(rows), sum(r["tokens"] for r in rows), sum(r["vocabulary"] for r in rows)

    def answer(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = _learned(right) if len(right) else {k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k in "gw"}
        asked_g = [pack.get_keys(b) for b in left["g"]]
        every = np.unique(np.concatenate(asked_g)) if asked_g else np.zeros(0, np.uint64)
        lengths = np.rint(code_lengths(every, Tree(*x["g"], depth, 2), high) / -UNIT).astype(np.uint64)
        out = []
        for r, g in zip(left.itertuples(), asked_g):
            w = pack.get_keys(r.w)
            n = np.zeros(len(w), np.int64)
            if len(x["w"][0]):
                at = np.minimum(np.searchsorted(x["w"][0], w), len(x["w"][0]) - 1)
                n = np.where(x["w"][0][at] == w, x["w"][1][at], 0)
            out.append((r.slice, r.bucket, pack.put(lengths[np.searchsorted(every, g)]), pack.put(n)))
        return pd.DataFrame(out, columns=["slice", "bucket", "lengths", "counts"])

    # a bucket's model goes out once for as many bytes of questions as it has itself, so all copies together grow with the questions
    questions = asked.groupBy("bucket").agg(F.sum(F.octet_length("g") + F.octet_length("w")).alias("bytes"))
    own = F.octet_length("g") + F.octet_length("gn") + F.octet_length("w") + F.octet_length("wn")
    served = common.stored(model.select("bucket", own.alias("own")).join(questions, "bucket").select("bucket", F.ceil(F.col("bytes") / F.greatest("own", F.lit(COPY_BYTES))).cast("long").alias("salts")))
    copies = model.join(served, "bucket").select("bucket", "g", "gn", "w", "wn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    asks = asked.select("bucket", "slice", "g", "w").join(served, "bucket").withColumn("salt", F.pmod(F.xxhash64("slice"), F.col("salts")))
    answers = common.stored(asks.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInPandas(answer, "slice long, bucket long, lengths binary, counts binary"))
    common.release(asked, model, served)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("bucket")
        out = []
        for r in left.itertuples():
            texts = normalized(*pack.unpacked(r.texts, r.lengths))
            n, sums = len(texts), {}
            for kind, (keys, own) in (("g", strings(texts, depth)), ("w", word_keys(texts))):
                distinct, at = np.unique(keys, return_inverse=True)
                b = _bucket(distinct, depth, buckets) if kind == "g" else (distinct % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                said = np.concatenate([pack.get(x, np.uint64) * -UNIT for x in right["lengths"]] if kind == "g" else [pack.get(x, np.int64) for x in right["counts"]])
                value = np.empty(len(distinct), said.dtype)
                value[order] = said
                value = value[at]
                if kind == "g":
                    sums["score"] = np.bincount(own, value, n)
                    sums["n_bytes"] = np.bincount(own, minlength=n)
                else:
                    sums["base"] = np.bincount(own, np.log10((value + 0.5) / (total + 0.5 * (vocabulary + 1))), n)
                    sums["known"] = np.bincount(own, value > 0, n)
                    sums["tokens"] = np.bincount(own, minlength=n)
            out.append(pd.DataFrame({"doc_id": pd.Series(pack.get_ids(r.ids).to_pylist(), dtype=object), "n_tokens": sums["tokens"], "n_known": sums["known"].astype(np.int64), "train_tokens": total, "base_score": sums["base"], "score": sums["score"], "n_bytes": sums["n_bytes"]}))
        return pd.concat(out)

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(finish, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the tree of those outside the held-out fifth; bits_per_byte is its code length."""
    docs = common.read_table(spark, sf_dir, "documents")
    found = score_documents(docs, common.crc_fold(F.col("doc_id")) != 1)
    return found.select("doc_id", (common.crc_fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
