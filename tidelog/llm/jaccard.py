"""Exact Jaccard join of documents on sets of word shingles.

In any one order of all shingles, two similar sets share one of their few first
shingles, so each document is filed under these. The order is from rare to
frequent, by counts over all documents in a table of fixed size in which
shingles share places by hash (any order gives the same links; this one keeps
common phrases from making large groups). The documents under one shingle form a
group; what shares none with any other document drops out.

Each remaining document goes to the tile of the smallest id that any of its
groups has in its size band or the next smaller one, and large tiles split into
parts that all hold that first document. Most tiles are small: those of one
document are not built, and the others follow one another in sorted partitions.
A tile's pairs of one size band or neighbouring ones are settled exactly. A signature of hashed bits (each bit the
parity of the shingles that fall on it) bounds a pair's overlap from above,
since every unequal bit needs a shingle in which the two differ; what passes is
settled by intersecting the sorted sets. A pair that is already in one component
is not compared, so copies, however many, cost one comparison each. At last the
pairs that share a group but neither a tile nor a component are compared the
same way, so no link between components is missed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pack
from .components import components

WORDS = 5
#: Similarity as a fraction: num / den.
NUM, DEN = 3, 4
#: Bytes of text that a bucket of hashes stands for; parts that a comparison leader's followers are dealt to.
BUCKET_BYTES, SALTS = 1 << 26, 64
#: Documents in a part of a tile, about, and how many are compared two by two without signatures.
TILE_ROWS, FEW = 256, 4
#: Places of the table of shingle counts, how many of them travel together, and how many parts of a sum one task adds.
PLACES, CHUNK, ADDED = 1 << 22, 1 << 16, 256
#: The bits of a shingle's hash that are dropped where candidates are sought; what they find is counted with all bits.
KEPT = np.uint64(16)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values: for these short arrays a sort takes a fifth of the time of numpy.unique, which hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's `size`-word shingles; a text with fewer words has its whole sequence as one."""
    data = common.LOWER[data]
    starts, ends, first = common.words(data, offsets)
    word = common.range_hash(common.prefix_hash(data), starts, ends)
    n = max(0, len(word) - size + 1)
    key = np.full(n, np.uint64(size))
    for i in range(size):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(distinct(key[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in word[a:b]:
                short = common.mix64(np.array([short], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int) -> int:
    """How many smallest hashes two similar sets cannot have all apart."""
    return n - -(-NUM * n // DEN) + 1


def band(n: np.ndarray) -> np.ndarray:
    """Size bands: similar sets are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(DEN / NUM) + 1e-9).astype(np.int64)


def signature(keys: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits, over about two bits a shingle."""
    bits = 64
    while bits < 2 * len(keys):
        bits *= 2
    return np.packbits(np.bincount((keys >> KEPT & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(signature_: bytes, size: int) -> np.ndarray:
    """The signature over fewer bits (`size` bytes), as 64-bit words."""
    x = np.frombuffer(signature_, np.uint64)
    while x.nbytes > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(na, nb, apart) -> np.ndarray:
    """Whether a pair with so many unequal bits can still be similar."""
    both = np.asarray(na) + np.asarray(nb)
    overlap = (both - apart) // 2
    return DEN * overlap >= NUM * (both - overlap)


def links(na: int, nb: int, overlap: int) -> bool:
    return DEN * overlap >= NUM * (na + nb - overlap)


def _digest(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _first_of_each_set(sets: list[np.ndarray], ids: list) -> dict[bytes, tuple[int, int]]:
    """For the sets in a slice: digest -> (smallest id, its index)."""
    first: dict[bytes, tuple[int, int]] = {}
    for i, (s, doc) in enumerate(zip(sets, ids)):
        if len(s) and doc is not None:
            digest = _digest(s)
            if digest not in first or doc < first[digest][0]:
                first[digest] = (doc, i)
    return first


def _places(keys: np.ndarray) -> np.ndarray:
    return (common.mix64(keys) & np.uint64(PLACES - 1)).astype(np.int64)


def _features(batches):
    """doc_id, n, rep (the slice's smallest id with the same set) and, for that one, the set's digest and signature. At last the counts of the task's shingles, one row a chunk."""
    counts = np.zeros(PLACES, np.uint32)
    for piece in common.slices(batches, "text"):
        ids = piece.column("doc_id").to_pylist()
        sets = shingle_sets(*common.text_bytes(piece.column("text")))
        first = _first_of_each_set(sets, ids)
        by = [first[_digest(s)] if len(s) and d is not None else (d, i) for i, (s, d) in enumerate(zip(sets, ids))]
        if first:
            counts += np.bincount(_places(np.concatenate([sets[i] for _, i in first.values()]) >> KEPT), minlength=PLACES).astype(np.uint32)
        n = len(ids)
        yield pa.record_batch(
            [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([b[0] for b in by], pa.int64()), pa.array([_digest(s) if b[1] == i and len(s) else None for i, (s, b) in enumerate(zip(sets, by))], pa.binary()), pa.array([signature(s) if b[1] == i and len(s) else None for i, (s, b) in enumerate(zip(sets, by))], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
            _FEATURE_NAMES,
        )
    if counts.any():
        n = PLACES // CHUNK
        yield pa.record_batch([pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.binary())] * 2 + [pa.array(range(n), pa.int64()), pa.array([pack.put(x.astype(np.uint64)) for x in counts.reshape(n, CHUNK)], pa.binary())], _FEATURE_NAMES)


_FEATURE_NAMES = ["doc_id", "n", "rep", "digest", "signature", "chunk", "counts"]


def _summed(key, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "counts": [pack.put(sum(pack.get(x, np.uint64) for x in frame["counts"]))]})


def rarity(counts: DataFrame) -> bytes:
    """Four classes for each doubling of the count, one byte a place, packed. Only this table, of PLACES bytes whatever the input, comes to the driver."""
    salts = max(1, -(-counts.groupBy("chunk").count().agg(F.max("count")).first()[0] // ADDED)) if not counts.isEmpty() else 1
    parts = counts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts))).groupBy("chunk", "salt").applyInPandas(_summed, "chunk long, counts binary")
    rows = parts.groupBy("chunk").applyInPandas(_summed, "chunk long, counts binary").collect()
    table = np.zeros(PLACES, np.uint8)
    for r in rows:
        table[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.minimum(4 * np.log2(1.0 + pack.get(r["counts"], np.uint64)), 255)
    return pack.put(table)


def _filed(buckets: int, rare: bytes):
    def run(batches):
        table = pack.get(rare, np.uint8)
        for piece in common.slices(batches, "text"):
            ids = piece.column("doc_id").to_pylist()
            sets = shingle_sets(*common.text_bytes(piece.column("text")))
            first = _first_of_each_set(sets, ids)
            kept = sorted((i, digest) for digest, (_, i) in first.items())
            if not kept:
                continue
            marks = np.frombuffer(b"".join(d[:8] for _, d in kept), np.uint64)
            kept = [i for i, _ in kept]
            every = np.concatenate([sets[i] for i in kept]) >> KEPT
            every |= table[_places(every)].astype(np.uint64) << np.uint64(48)
            cut = np.cumsum([0, *[len(sets[i]) for i in kept]]).tolist()
            lengths = [prefix_length(b - a) for a, b in zip(cut, cut[1:])]
            keys = np.concatenate([np.partition(every[a:b], n - 1)[:n] for a, b, n in zip(cut, cut[1:], lengths)]) & np.uint64((1 << 48) - 1)
            own = np.repeat(np.arange(len(kept)), lengths)
            docs, sizes = np.array([ids[i] for i in kept], np.int64), np.array([len(sets[i]) for i in kept], np.int64)
            b = (common.mix64(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((keys, b))
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            rows = []
            for i in range(buckets):
                some = order[cut[i] : cut[i + 1]]
                if len(some):
                    who, at = np.unique(own[some], return_inverse=True)
                    rows.append((i, pack.put_keys(keys[some]), pack.put(at.astype(np.uint32)), pack.put(docs[who]), pack.put(sizes[who].astype(np.uint32)), marks[who].tobytes()))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), *[pa.binary()] * 5))], ["bucket", "keys", "own", "docs", "sizes", "marks"])

    return run


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, sizes, and (group, document index) of a bucket's packed groups."""
    return pack.get(r.docs, np.int64), pack.get(r.sizes, np.uint32).astype(np.int64), pack.get(r.groups, np.uint32).astype(np.int64), pack.get(r.own, np.uint32).astype(np.int64)


def _grouped(key, frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's groups: the documents of all hashes that two or more have. Groups of the same documents are one, and so are documents with the same set (64 bits of its digest within one group)."""
    docs, sizes, keys, own, base = [], [], [], [], 0
    for r in frame.itertuples():
        d = pack.get(r.docs, np.int64)
        docs.append(d)
        sizes.append(pack.get(r.sizes, np.uint32))
        keys.append(pack.get_keys(r.keys))
        own.append(pack.get(r.own, np.uint32).astype(np.int64) + base)
        base += len(d)
    marks = np.frombuffer(b"".join(frame["marks"]), np.uint64)
    docs, sizes, keys, own = (np.concatenate(x) for x in (docs, sizes, keys, own))
    # the smallest id stands for all with its set
    order = np.lexsort((docs, marks))
    new = np.concatenate([[True], marks[order][1:] != marks[order][:-1]])
    stands = np.empty(len(docs), np.int64)
    stands[order] = order[new][np.cumsum(new) - 1]
    own = stands[own]
    order = np.lexsort((docs[own], keys))
    keys, own = keys[order], own[order]
    once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])
    keys, own = keys[once], own[once]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(starts, len(keys)))
    marks = np.add.reduceat(common.mix64(docs[own].astype(np.uint64)), starts)
    many = np.flatnonzero(lengths > 1)
    _, first = np.unique(np.stack([marks[many], lengths[many].astype(np.uint64)], 1), axis=0, return_index=True)
    keep = np.zeros(len(starts), bool)
    keep[many[first]] = True
    some = np.repeat(keep, lengths)
    group = np.repeat(np.arange(len(starts)), lengths)[some]
    _, group = np.unique(group, return_inverse=True)
    used, at = np.unique(own[some], return_inverse=True)
    return pd.DataFrame([(key[0], pack.put(docs[used]), pack.put(sizes[used].astype(np.uint32)), pack.put(group.astype(np.uint32)), pack.put(at.astype(np.uint32)))], columns=["bucket", "docs", "sizes", "groups", "own"])


def _leaders(frames):
    """(bucket, doc_id, leader): the smallest id in any of a document's groups, in its size band or the next smaller one."""
    for frame in frames:
        for r in frame.itertuples():
            docs, sizes, group, own = _arrays(r)
            if not len(group):
                continue
            tile = (group << 8) | band(sizes[own])
            order = np.lexsort((docs[own], tile))
            tile, own = tile[order], own[order]
            at = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            first = docs[own[at]]
            lead = first[np.searchsorted(tile[at], tile)]
            below = np.minimum(np.searchsorted(tile[at], tile - 1), len(at) - 1)
            lead = np.where(tile[at][below] == tile - 1, np.minimum(lead, first[below]), lead)
            order = np.lexsort((lead, own))
            own, lead = own[order], lead[order]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            yield pd.DataFrame({"bucket": np.full(int(new.sum()), r.bucket), "doc_id": docs[own[new]], "leader": lead[new]})


def overlaps(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """How many elements each two of the sorted sets share: the sorted union is gone through in pieces, each a matrix of who has what."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    counts = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    # what one set alone has is shared with none
    several = counts[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[several], column[several]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column.max()) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [start, start + columns])
        has = np.zeros((len(sets), min(columns, int(column[b - 1]) + 1 - start)), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        out += has @ has.T
    return np.rint(out).astype(np.int64)


def spanning(ids: np.ndarray, similar: np.ndarray) -> list[tuple[int, int]]:
    """Just enough links to join what the matrix links."""
    out, left = [], np.ones(len(ids), bool)
    for i in range(len(ids)):
        if not left[i]:
            continue
        left[i] = False
        edge = [i]
        while edge:
            near = np.flatnonzero(similar[edge[-1]] & left)
            at = edge.pop()
            left[near] = False
            out.extend((ids[at], ids[j]) for j in near.tolist())
            edge.extend(near.tolist())
    return out


def similar_of_few(n: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of which sets are similar, by intersecting each two."""
    out = np.zeros((len(n), len(n)), bool)
    for i in range(len(n)):
        for j in range(i):
            if DEN * min(n[i], n[j]) >= NUM * max(n[i], n[j]):
                out[i, j] = out[j, i] = links(int(n[i]), int(n[j]), len(np.intersect1d(sets[i], sets[j], assume_unique=True)))
    return out


def similar_of_many(n: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The same of many sets in the order of their sizes: bit signatures bound the overlap of each two from above; only documents that this leaves a chance meet in the exact count."""
    near = (np.abs(band(n)[:, None] - band(n)[None, :]) <= 1) & (DEN * np.minimum(n[:, None], n[None, :]) >= NUM * np.maximum(n[:, None], n[None, :]))
    np.fill_diagonal(near, False)
    signs = [signature(s) for s in sets]
    for b in np.unique(band(n)):
        here = np.flatnonzero(np.abs(band(n) - b) <= 1)
        mine = np.flatnonzero(band(n) == b)
        size = min(len(signs[i]) for i in here)
        bits = np.stack([folded(signs[i], size) for i in here])
        for i in mine.tolist():
            apart = np.bitwise_count(bits ^ bits[np.searchsorted(here, i)]).sum(axis=1, dtype=np.int64)
            near[i, here] &= may_link(n[i], n[here], apart)
    near &= near.T
    hope = np.flatnonzero(near.any(axis=1))
    if len(hope):
        shared = overlaps([sets[i] for i in hope])
        near[np.ix_(hope, hope)] &= DEN * shared >= NUM * (n[hope][:, None] + n[hope][None, :] - shared)
    return near


_NO_PAIRS = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _tile(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Links that join what is similar within one part of a tile: each component gets just enough of them."""
    ids, n, keys = frame["id"].to_numpy(), frame["n"].to_numpy().astype(np.int64), frame["keys"].to_numpy()
    once = np.unique(ids, return_index=True)[1]
    order = once[np.lexsort((ids[once], n[once]))]
    # in the order of sizes what fits none of its neighbours fits no one
    fit = DEN * n[order][:-1] >= NUM * n[order][1:]
    order = order[np.concatenate([fit, [False]]) | np.concatenate([[False], fit])]
    if not len(order):
        return _NO_PAIRS
    ids, n, sets = ids[order], n[order], [pack.get_keys(k) for k in keys[order]]
    similar = (similar_of_few if len(ids) <= FEW else similar_of_many)(n, sets)
    return pd.DataFrame(spanning(ids, similar), columns=["a", "b"]).astype("int64") if similar.any() else _NO_PAIRS


def _tiles(frames):
    """The links of all tiles of a partition, whose rows stand by (leader, part); a tile may go on in the next frame."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        leader, part = frame["leader"].to_numpy(), frame["part"].to_numpy()
        cut = [0, *(np.flatnonzero((leader[1:] != leader[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]
        rest = frame.iloc[cut[-1] :]
        found = [_tile(None, frame.iloc[a:b]) for a, b in zip(cut, cut[1:]) if b - a > 1]
        yield pd.concat([_NO_PAIRS, *[x for x in found if len(x)]])
    if rest is not None:
        yield _tile(None, rest)


def _crossing(key, frame: pd.DataFrame, known: pd.DataFrame) -> tuple | None:
    """A bucket's arrays with each document's component and tile, only of groups with several of both."""
    if not len(frame) or not len(known):
        return None
    docs, sizes, group, own = _arrays(next(frame.itertuples()))
    table = known.drop_duplicates("doc_id").sort_values("doc_id")
    at = np.minimum(np.searchsorted(table["doc_id"].to_numpy(), docs), len(table) - 1)
    return docs, sizes, group, own, table["component"].to_numpy()[at], table["tile"].to_numpy()[at], table, at


def _mixed_groups(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    differ = np.minimum.reduceat(values, starts) != np.maximum.reduceat(values, starts)
    return np.repeat(differ, np.diff(np.append(starts, len(group))))


def _open(key, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """(bucket, doc_id, component, tile) of the documents in groups that hold several components and several tiles."""
    x = _crossing(key, frame, known)
    empty = pd.DataFrame({k: np.zeros(0, np.int64) for k in ("bucket", "doc_id", "component", "tile")})
    if x is None or not len(x[2]):
        return empty
    docs, _, group, own, component, tile, _, _ = x
    some = np.unique(own[_mixed_groups(group, component[own]) & _mixed_groups(group, tile[own])])
    return pd.DataFrame({"bucket": np.full(len(some), key[0]), "doc_id": docs[some], "component": component[some], "tile": tile[some]}) if len(some) else empty


def _across(key, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one group, two components and two tiles whose signatures leave them a chance."""
    empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    x = _crossing(key, frame, known)
    if x is None or not len(x[2]):
        return empty
    docs, sizes, group, own, component, tile, table, at = x
    here = table["doc_id"].to_numpy()[at] == docs
    keep = here[own]
    group, own = group[keep], own[keep]
    if not len(group):
        return empty
    signatures, out = table["signature"].to_numpy(), []
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for s, e in zip(starts, np.append(starts[1:], len(group))):
        who = own[s:e]
        p, t = component[who], tile[who]
        if (p == p[0]).all() or (t == t[0]).all():
            continue
        order = np.argsort(sizes[who], kind="stable")
        who, p, t = who[order], p[order], t[order]
        n, ids = sizes[who], docs[who]
        values, counts = np.unique(p, return_counts=True)
        largest = values[np.argmax(counts)]
        bands = band(n)
        for b in np.unique(bands):
            mine, near = np.flatnonzero(bands == b), np.flatnonzero((bands == b) | (bands == b + 1))
            size = min(len(signatures[at[who[i]]]) for i in mine)
            bits = np.stack([folded(signatures[at[who[i]]], size) for i in near])
            for i in mine.tolist():
                # within the band the one outside the largest component looks, or the earlier of two such; towards the next band every one does
                look = (p[near] != p[i]) & (t[near] != t[i]) & ((bands[near] == b + 1) | ((p[i] != largest) & ((p[near] == largest) | (near > i))))
                look &= DEN * np.minimum(n[i], n[near]) >= NUM * np.maximum(n[i], n[near])
                other = np.flatnonzero(look)
                if len(other):
                    apart = np.bitwise_count(bits[other] ^ bits[np.searchsorted(near, i)]).sum(axis=1, dtype=np.int64)
                    other = near[other[may_link(n[i], n[near[other]], apart)]]
                    out.append(np.stack([np.minimum(ids[i], ids[other]), np.maximum(ids[i], ids[other])], 1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"]) if out else empty


def _sets(with_tile: bool):
    def run(batches):
        for piece in common.slices(batches, "text"):
            sets = shingle_sets(*common.text_bytes(piece.column("text")))
            own = [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack.put_keys(s) for s in sets], pa.binary())]
            yield pa.record_batch([piece.column("leader"), piece.column("part"), *own] if with_tile else own, ["leader", "part"] * with_tile + ["id", "n", "keys"])

    return run


def _settled(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one leader that are similar; left: the leader's set, right: the others'."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    n, keys = int(left["na"].iloc[0]), pack.get_keys(left["ka"].iloc[0])
    ok = [links(n, int(m), len(np.intersect1d(keys, pack.get_keys(k), assume_unique=True))) for m, k in zip(right["nb"], right["kb"])]
    return pd.DataFrame({"a": np.full(sum(ok), key[0]), "b": right["b"].to_numpy()[ok]})


_PAIR = "a long, b long"


def tiled(led: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, leader): each document's tile (doc_id, leader, part, met), and (doc_id, leader, part) of what tiles of several documents hold: theirs, and a leader in its own tile and in each part of that."""
    parts = common.stored(led.groupBy("leader").agg(F.ceil(F.count("*") / TILE_ROWS).cast("long").alias("parts"), (F.max("doc_id") > F.col("leader")).alias("met")))
    homes = common.stored(led.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).select("doc_id", "leader", "part", "met"))
    leads = parts.filter("met").select(F.col("leader").alias("doc_id"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    places = common.stored(homes.filter("met").select("doc_id", "leader", "part").unionByName(leads).distinct())
    common.release(led, parts)
    return homes, places


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Words are lower-cased (A-Z). A null, empty or blank text has no shingles and links with nothing; neither does a row
    whose doc_id is null, and its component_id is null. Rows that repeat an id are one document of the join.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = common.stored(docs.mapInArrow(_features, "doc_id long, n long, rep long, digest binary, signature binary, chunk long, counts binary"))
    feature = found.filter(F.col("chunk").isNull()).select("doc_id", "n", "rep", "digest", "signature")
    rare = rarity(found.filter(F.col("chunk").isNotNull()).select("chunk", "counts"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(4096, max(4, -(-size // BUCKET_BYTES))))
    filed = docs.mapInArrow(_filed(buckets, rare), "bucket long, keys binary, own binary, docs binary, sizes binary, marks binary")
    groups = common.stored(filed.groupBy("bucket").applyInPandas(_grouped, "bucket long, docs binary, sizes binary, groups binary, own binary"))
    common.release()
    members = common.stored(groups.mapInPandas(_leaders, "bucket long, doc_id long, leader long"))
    # the first of each set in its slice, linked with the first of all
    firsts = feature.filter(F.col("signature").isNotNull())
    whole = firsts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    same = firsts.join(whole, "digest").filter(F.col("doc_id") > F.col("first")).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    copies = same.union(feature.filter(F.col("rep") < F.col("doc_id")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    tables = firsts.select("doc_id", "signature").dropDuplicates(["doc_id"])

    homes, places = tiled(common.stored(members.groupBy("doc_id").agg(F.min("leader").alias("leader"))))
    # never broadcast, as it grows with the documents
    placed = docs.join(places.hint("merge"), "doc_id").select("doc_id", "text", "leader", "part").mapInArrow(_sets(True), "leader long, part long, id long, n long, keys binary")
    first = common.stored(placed.repartition("leader", "part").sortWithinPartitions("leader", "part").mapInPandas(_tiles, _PAIR).union(copies))
    common.release(places)
    joined = common.stored(components(first))
    common.release()

    # what shares a group, but neither a tile nor a component
    tile = F.xxhash64("leader", "part").alias("tile")
    state = homes.select("doc_id", tile).join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "tile", F.coalesce("component_id", "doc_id").alias("component"))
    known = members.select("bucket", "doc_id").join(state, "doc_id")
    open_ = groups.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(_open, "bucket long, doc_id long, component long, tile long")
    signed = common.stored(open_.join(tables, "doc_id").select("bucket", "doc_id", "component", "tile", "signature"))
    common.release(members, homes)
    across = common.stored(groups.groupBy("bucket").cogroup(signed.groupBy("bucket")).applyInPandas(_across, _PAIR).distinct())
    common.release(groups, signed)
    if not across.isEmpty():
        salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
        wanted = across.select(F.col("a").alias("doc_id")).union(across.select("b")).distinct()
        sets = common.stored(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(False), "id long, n long, keys binary"))
        common.release()
        of_b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb")).dropDuplicates(["b"])
        of_a = sets.select(F.col("id").alias("lead"), F.col("n").alias("na"), F.col("keys").alias("ka")).dropDuplicates(["lead"])
        right = across.join(of_b, "b").select("a", salt.alias("salt"), "b", "nb", "kb")
        left = across.select(F.col("a").alias("lead"), salt.alias("lead_part")).distinct().join(of_a, "lead")
        second = common.stored(left.groupBy("lead", "lead_part").cogroup(right.groupBy("a", "salt")).applyInPandas(_settled, _PAIR))
        common.release(joined, sets)
        joined = common.stored(components(first.union(second)))
        common.release(second)
    common.release(across, first)
    return feature.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest id, all columns as they were; rows that repeat its id stay one."""
    found = common.stored(similar_documents(docs))
    stays = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"))
    repeated = common.stored(stays.filter(F.col("__id").isNotNull() & (F.col("__rows") > 1)).select("__id"))
    kept = docs.join(stays.select("__id"), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["__id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, kept["doc_id"] == repeated["__id"], "left_anti").unionByName(once)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and the smallest id that links reach from it."""
    return similar_documents(common.read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = d.doc_id
"""
