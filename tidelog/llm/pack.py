"""Sorted keys and counts as small binary columns, and documents packed into slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _planes(x: np.ndarray) -> bytes:
    """zstd over the byte planes of an array: high bytes of small numbers vanish."""
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unplanes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


def put_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def get_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob, np.uint64), dtype=np.uint64)


def put(x: np.ndarray) -> bytes:
    return _planes(np.ascontiguousarray(x))


def get(blob: bytes, kind) -> np.ndarray:
    return _unplanes(blob, kind)


def put_ids(ids: pa.Array) -> bytes:
    """Ids of any type as an Arrow stream: nulls and large numbers stay what they are."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def get_ids(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_next_batch().column(0)


def packed_documents(docs: DataFrame, limit: int = common.SLICE_BYTES, flag=None) -> DataFrame:
    """Rows (slice, ids, flags, lengths, texts, raw) of about `limit` bytes of text each, in a table of the shared folder.

    ids: the doc_ids, see get_ids; flags: the values of the boolean column `flag`; lengths: bytes of each text; texts: zstd of all
    texts, null as empty; raw: bytes before zstd. Later stages read the same slices however often they run.
    """
    rows = docs.select("doc_id", (F.lit(False) if flag is None else flag).alias("flag"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for piece in common.slices(batches, "text", limit):
            data, offsets = common.text_bytes(piece.column("text"))
            yield pa.record_batch(
                [
                    pa.array([put_ids(piece.column("doc_id"))], pa.binary()),
                    pa.array([piece.column("flag").to_pylist()]),
                    pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                    pa.array([zstandard.ZstdCompressor(6).compress(data.tobytes())], pa.binary()),
                    pa.array([len(data)], pa.int64()),
                ],
                ["ids", "flags", "lengths", "texts", "raw"],
            )

    packed = rows.mapInArrow(run, "ids binary, flags array<boolean>, lengths array<long>, texts binary, raw long")
    return common.stored(packed.withColumn("slice", F.monotonically_increasing_id()))


def unpacked(texts: bytes, lengths) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice and the n + 1 offsets of its documents."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8) if len(texts) else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
