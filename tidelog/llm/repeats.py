"""Repeated passages from a bucketed enhanced suffix array.

Every window of `length` bytes has one anchor, the start of its smallest hashed
run of ANCHOR bytes, so equal windows have equal anchors. A suffix array over
anchors, each suffix with the bytes that any of its windows reaches before and
after it, is dealt by the anchor's hash: all suffixes with a common prefix are
in one bucket. There a stack scan over the longest-common-prefix array builds
the interval tree; an interval whose suffixes differ in what stands to their
left, or one end of which is an end of text, is left-diverse and its prefix a
maximal repeat within reach. Its output has every occurrence, not only
neighbouring pairs, and each window's earliest one.

To keep the shuffle small, an anchor first travels as two hashes: of its run and
of its whole surroundings. Where the whole surroundings occur in an earlier
document every window of the anchor is repeated, and only the rest, at the edges
of passages, travel as text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pack

LENGTH, ANCHOR = 50, 20
#: Bytes of text that a bucket of anchors stands for.
BUCKET_BYTES = 1 << 24
_PLACE = np.uint64((1 << 24) - 1)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest value in each run of `width`."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """The anchors of a slice's texts. Ties within a window go to the leftmost."""

    def __init__(self, r, length: int, size: int):
        """r: a slice. Texts without an id have no anchors."""
        ids = pack.get_ids(r.ids)
        self.ids, known = np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())
        self.data, self.offsets = data, offsets = pack.unpacked(r.texts, r.lengths)
        self.place = self.text = np.zeros(0, np.int64)
        if len(data) >= length:
            prefix = common.prefix_hash(data)
            at = np.arange(len(data) - size + 1)
            # a hash and its place in one number: the smallest is the leftmost of the smallest hashes
            hashed = common.range_hash(prefix, at, at + size) & ~_PLACE | at.astype(np.uint64) & _PLACE
            least = _window_least(hashed, length - size + 1)
            starts = np.arange(len(least))
            ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
            place = starts + (((least & _PLACE).astype(np.int64) - starts) & int(_PLACE))
            # where places start again at 0 within a window, its leftmost smallest hash is looked up
            width, turn = length - size + 1, int(_PLACE) + 1
            for edge in range(turn, len(hashed), turn):
                for s in range(max(0, edge - width + 1), min(edge, len(place))):
                    place[s] = s + int(np.argmin(hashed[s : s + width] & ~_PLACE))
            place = place[starts + length <= ends]
            self.place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
            self.text = np.searchsorted(offsets, self.place, "right") - 1
            self.place, self.text = self.place[known[self.text]], self.text[known[self.text]]
        # the bytes that windows over an anchor can reach, cut at the ends of its text
        self.start = np.maximum(self.place - (length - size), offsets[self.text])
        self.end = np.minimum(self.place + length, offsets[self.text + 1])
        if len(self.place):
            self.run = common.range_hash(prefix, self.place, self.place + size) >> np.uint64(16)
            cut = ((self.place - self.start) * 1024 + (self.end - self.place)).astype(np.uint64)
            self.around = common.mix64(common.range_hash(prefix, self.start, self.end) + cut) >> np.uint64(24)
        else:
            self.run = self.around = np.zeros(0, np.uint64)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of equal anchors with equal surroundings the one of the smallest id, in order of run; and which of those stands for each anchor."""
        own = self.ids[self.text]
        order = np.lexsort((own, self.around, self.run))
        r, a = self.run[order], self.around[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1])]) if len(r) else np.zeros(0, bool)
        stands = np.empty(len(r), np.int64)
        stands[order] = np.cumsum(new) - 1
        return order[new], stands


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _asked(buckets: int, length: int, size: int):
    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                x = Anchors(r, length, size)
                ids, (first, _) = x.ids, x.firsts()
                order, cut = _dealt((x.run[first] % np.uint64(buckets)).astype(np.int64), buckets)
                rows = []
                for i in range(buckets):
                    some = first[order[cut[i] : cut[i + 1]]]
                    if len(some):
                        docs, own = np.unique(ids[x.text[some]], return_inverse=True)
                        rows.append((i, r.slice, pack.put_keys(x.run[some]), pack.put(x.around[some]), pack.put(docs), pack.put(own.astype(np.uint32))))
                yield pd.DataFrame(rows, columns=["bucket", "slice", "runs", "around", "docs", "own"])

    return run


def _verdicts(key, frame: pd.DataFrame) -> pd.DataFrame:
    """For each anchor: 0 no other document or surrounding has its run, 1 its whole surroundings stand in an earlier document, 2 to be looked at."""
    runs = [pack.get_keys(b) for b in frame["runs"]]
    run, around = np.concatenate(runs), np.concatenate([pack.get(b, np.uint64) for b in frame["around"]])
    ids = np.concatenate([pack.get(d, np.int64)[pack.get(o, np.uint32)] for d, o in zip(frame["docs"], frame["own"])])
    order = np.lexsort((ids, around, run))
    r, a, d = run[order], around[order], ids[order]
    new_run = np.concatenate([[True], r[1:] != r[:-1]])
    new = new_run | np.concatenate([[True], a[1:] != a[:-1]])
    first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = np.cumsum(new_run) - 1
    starts = np.flatnonzero(new_run)
    several = np.add.reduceat(new.astype(np.int64), starts)[group] > 1
    several &= (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts))[group]
    verdict = np.empty(len(run), np.uint8)
    verdict[order] = np.where(first < d, 1, np.where(several, 2, 0))
    cut = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
    return pd.DataFrame({"slice": frame["slice"], "bucket": frame["bucket"], "verdicts": [pack.put(verdict[x:y]) for x, y in zip(cut[:-1], cut[1:])]})


def _judged(buckets: int, length: int, size: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of a slice: the spans (bucket -1) that whole surroundings settle, and for each bucket the surroundings to be looked at."""
        rows = []
        for r in left.itertuples():
            x = Anchors(r, length, size)
            ids = x.ids
            if not len(x.place):
                continue
            first, stands = x.firsts()
            order, _ = _dealt((x.run[first] % np.uint64(buckets)).astype(np.int64), buckets)
            said = np.empty(len(first), np.uint8)
            said[order] = np.concatenate([pack.get(b, np.uint8) for b in right.sort_values("bucket")["verdicts"]])
            verdict = said[stands]
            verdict[ids[x.text] > ids[x.text[first]][stands]] = 1
            base = x.offsets[x.text]
            sure = np.flatnonzero(verdict == 1)
            rows.append((r.slice, -1, pack.put(x.text[sure].astype(np.uint32)), b"", pack.put(x.start[sure] - base[sure]), pack.put(x.end[sure] - base[sure]), b""))
            look = np.flatnonzero(verdict == 2)
            b = (x.run[look] % np.uint64(buckets)).astype(np.int64)
            order, cut = _dealt(b, buckets)
            for i in np.unique(b).tolist():
                some = look[order[cut[i] : cut[i + 1]]]
                reach = b"".join([x.data[s:e].tobytes() for s, e in zip(x.start[some].tolist(), x.end[some].tolist())])
                sides = np.stack([x.place[some] - x.start[some], x.end[some] - x.start[some]], 1).astype(np.uint32).ravel()
                rows.append((r.slice, i, pack.put(x.text[some].astype(np.uint32)), pack.put(ids[x.text[some]]), pack.put(x.place[some] - base[some]), pack.put(sides), reach))
        return pd.DataFrame(rows, columns=["slice", "bucket", "texts", "ids", "a", "b", "reach"])

    return run


def common_prefixes(suffixes: list[bytes]) -> list[int]:
    """The longest common prefix of each suffix with the one before it; 0 for the first."""
    out = [0]
    for a, b in zip(suffixes, suffixes[1:]):
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        out.append(n - (differ.bit_length() + 7) // 8)
    return out


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of the common-prefix tree whose prefix has `least` or more, by one scan with a stack."""
    out, stack = [], []
    for i, h in enumerate([*lcp[1:], -1], 1):
        first = i - 1
        while stack and stack[-1][0] > h:
            n, first = stack.pop()
            if n >= least:
                out.append((n, first, i - 1))
        if not stack or stack[-1][0] < h:
            stack.append((h, first))
    return out


def maximal_repeats(before: list[bytes], after: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """(m, n, members): the repeats of m bytes before and n bytes from an anchor, m + n >= length, that neither side can extend.

    A node of the tree over `after` cannot be extended to the right. The left sides of its suffixes, read backwards, are
    scanned the same way; a node of theirs is left-diverse: what stands next to the left differs among its members, or a
    side ends. members: all the anchors that have the repeat, as indexes.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    most = max(map(len, before), default=0)
    out = []
    for n, a, b in intervals(common_prefixes([after[i] for i in order]), max(1, length - most)):
        members = sorted((before[i][::-1], i) for i in order[a : b + 1])
        for m, c, d in intervals(common_prefixes([x for x, _ in members]), max(0, length - n)):
            out.append((m, n, [i for _, i in members[c : d + 1]]))
    return out


def _looked(length: int, size: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        """The spans of one bucket's anchors, in maximal repeats that an earlier document has too."""
        slices, texts, ids, places, groups = [], [], [], [], {}
        for r in frame.itertuples():
            sides = pack.get(r.b, np.uint32).reshape(-1, 2).tolist()
            at, base = 0, len(slices)
            slices += [r.slice] * len(sides)
            texts += pack.get(r.texts, np.uint32).tolist()
            ids += pack.get(r.ids, np.int64).tolist()
            places += pack.get(r.a, np.int64).tolist()
            for i, (mid, total) in enumerate(sides):
                x = r.reach[at : at + total]
                groups.setdefault(x[mid : mid + size], []).append((x[:mid], x[mid:], base + i))
                at += total
        spans: dict[int, list] = {}
        for members in groups.values():
            if len(members) < 2:
                continue
            for m, n, some in maximal_repeats([x[0] for x in members], [x[1] for x in members], length):
                who = [members[i][2] for i in some]
                earliest = min(ids[w] for w in who)
                for w in who:
                    if ids[w] > earliest:
                        spans.setdefault(slices[w], []).append((texts[w], places[w] - m, places[w] + n))
        rows = []
        for s, found in spans.items():
            x = np.array(found, np.int64)
            rows.append((s, pack.put(x[:, 0].astype(np.uint32)), pack.put(x[:, 1]), pack.put(x[:, 2])))
        return pd.DataFrame(rows, columns=["slice", "texts", "a", "b"])

    return run


def _removed(with_spans: bool):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            data, offsets = pack.unpacked(r.texts, r.lengths)
            edge = np.zeros(len(data) + 1, np.int64)
            for s in right.itertuples():
                base = offsets[pack.get(s.texts, np.uint32)]
                np.add.at(edge, base + pack.get(s.a, np.int64), 1)
                np.add.at(edge, base + pack.get(s.b, np.int64), -1)
            gone = np.cumsum(edge)[:-1] > 0
            for i, doc in enumerate(pack.get_ids(r.ids).to_pylist()):
                x, kept = gone[offsets[i] : offsets[i + 1]], data[offsets[i] : offsets[i + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8)))
                row = [doc, len(x), int(x.sum()), len(turns) // 2, hashlib.sha256(kept[~x].tobytes()).hexdigest()]
                out.append((*row, turns.reshape(-1, 2).tolist()) if with_spans else tuple(row))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans"] * with_spans)
        frame["doc_id"] = pd.Series([row[0] for row in out], dtype=object)  # beside a null, pandas would make doubles of them
        return frame

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every whole text; with_spans adds the removed (start, end) byte ranges.

    A byte is removed if a string of `length` bytes over it also stands in a document with a smaller doc_id. A null text
    is empty and loses nothing. Rows that repeat an id are one document and take nothing from each other. Rows without
    an id neither lose nor take. doc_id is an integer; it comes back as a long.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("doc_id must be an integer, as documents are told apart by the smaller one")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    slices = pack.packed_documents(docs)
    total = slices.agg(F.sum("raw")).first()[0] or 0
    buckets = int(min(4096, max(4, -(-total // BUCKET_BYTES), common.parts(docs.sparkSession))))
    asked = slices.mapInPandas(_asked(buckets, length, size), "bucket long, slice long, runs binary, around binary, docs binary, own binary")
    said = asked.groupBy("bucket").applyInPandas(_verdicts, "slice long, bucket long, verdicts binary")
    judged = slices.groupBy("slice").cogroup(said.groupBy("slice")).applyInPandas(_judged(buckets, length, size), "slice long, bucket long, texts binary, ids binary, a binary, b binary, reach binary")
    judged = common.stored(judged)
    looked = judged.filter(F.col("bucket") >= 0).groupBy("bucket").applyInPandas(_looked(length, size), "slice long, texts binary, a binary, b binary")
    spans = common.stored(judged.filter(F.col("bucket") < 0).select("slice", "texts", "a", "b").unionByName(looked))
    common.release(judged)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>" * with_spans
    return slices.groupBy("slice").cogroup(spans.groupBy("slice")).applyInPandas(_removed(with_spans), schema)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 bytes that a document with a smaller id has."""
    return repeated_passages(common.read_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), x AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM h)
), f AS (
  SELECT w, min(doc_id) AS first FROM x WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT x.doc_id, i, byte, max(CASE WHEN f.first < x.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM x LEFT JOIN f ON x.w = f.w
), t AS (
  SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS starts FROM g
), a AS (
  SELECT doc_id, sum(gone) AS n_removed, sum(starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM t GROUP BY 1
)
SELECT h.doc_id, CAST(len(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN a ON a.doc_id = h.doc_id
"""
