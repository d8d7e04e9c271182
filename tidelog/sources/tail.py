"""Text files by byte ranges: the end of a file, and what has been appended to it since.

Both are Python data sources. A partition is a range of bytes of one file, a line
belongs to the range in which it starts, and every row says where in the file its
line stands. Files are opened by `pyarrow.fs`, so paths may be local or URIs of
any store that it knows. A line ends at \\n; a \\r before it is no part of it.
Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import fnmatch
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Bytes read from a file's end for events and for its last lines, bytes that a delta takes of one file, and the age at which a file counts as dead.
TAIL_BYTES, LAST_LINES_BYTES, DELTA_BYTES, STALE_MS = 1_048_576, 65_536, 262_144, 120_000
#: Bytes in one partition, bytes read at once, bytes at a file's start by which a new file of the same name is told from the old one, and rows in an Arrow batch.
SPLIT_BYTES, CHUNK_BYTES, HEAD_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 256, 8192

LINES = "path string, offset long, end long, complete boolean, line string"
DELTA = LINES + ", from_offset long, new_offset long, status array<string>"


def _opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str = "*") -> list[tuple[str, int, int]]:
    """(path, bytes, milliseconds of the last write) of the file, or of a folder's files whose names fit, in order of path."""
    from pyarrow import fs

    system, inner = _opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    found = [i for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob)]
    return sorted((prefix + i.path, i.size, (i.mtime_ns or 0) // 1_000_000) for i in found)


@dataclass
class Range(InputPartition):
    """Lines that start in [start, end) of a file of which bytes below `high` count; `whole`: a line starts at `start` for certain."""

    path: str
    start: int
    end: int
    high: int
    whole: bool
    since: int = 0
    status: tuple[str, ...] = ()
    report: bool = False


def ranges(path: str, low: int, high: int, split: int, whole: bool, **more) -> list[Range]:
    """[low, high) cut into partitions. Only the first may begin with a line for certain; a line cut by `low` is left out."""
    starts = range(low, high, split) if high > low else ()
    return [Range(path, a, min(a + split, high), high, whole and a == low, **more) for a in starts]


def lines_in(part: Range) -> Iterator[tuple[int, int, bool, bytes]]:
    """(offset, end, complete, line) of a range's lines. Besides the range only the rest of its last line is read, and one byte before it."""
    system, inner = _opened(part.path)
    with system.open_input_file(inner) as f:
        at = part.start
        if part.start and not part.whole:
            f.seek(part.start - 1)
            skip = f.read(1) != b"\n"
        else:
            f.seek(part.start)
            skip = False
        held, pieces = at, []  # where the open line began, and what has been read of it
        while True:
            chunk = f.read(min(CHUNK_BYTES, part.high - at))
            if not chunk:
                break
            begin = 0
            while (cut := chunk.find(b"\n", begin)) >= 0:
                end = at + cut + 1
                if not skip:
                    pieces.append(chunk[begin:cut])
                    line = b"".join(pieces)
                    yield held, end, True, line[:-1] if line.endswith(b"\r") else line
                skip, held, pieces, begin = False, end, [], cut + 1
                if held >= part.end:
                    return
            if not skip:
                pieces.append(chunk[begin:])
            at += len(chunk)
        if pieces and not skip and (line := b"".join(pieces)):
            yield held, at, False, line


def _batches(part: Range, more: tuple = ()) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    names = ["path", "offset", "end", "complete", "line", "from_offset", "new_offset", "status"]
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[: len(rows[0])])

    for offset, end, complete, line in lines_in(part):
        rows.append((part.path, offset, end, complete, line.decode("utf-8", "replace"), *more))
        size += len(line)
        if len(rows) >= BATCH_ROWS or size >= CHUNK_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class TailSource(DataSource):
    """The lines in the last `tailBytes` bytes (0: all) of each file, below `maxOffset` (one number, or a JSON object by path; 0: its size). Options: path, glob, tailBytes, maxOffset, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(self.options)


class _TailReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.tail, self.split = int(options.get("tailBytes", TAIL_BYTES)), int(options.get("splitBytes", SPLIT_BYTES))
        self.pinned = json.loads(options.get("maxOffset", "0"))

    def partitions(self):
        out = []
        for path, size, _ in listed(self.path, self.glob):
            pin = self.pinned.get(path, 0) if isinstance(self.pinned, dict) else self.pinned
            high = min(size, pin) if pin else size
            low = max(0, high - self.tail) if self.tail else 0
            out += ranges(path, low, high, self.split, low == 0)
        return out or [Range("", 0, 0, 0, True)]

    def read(self, partition):
        return _batches(partition) if partition.path else iter(())


class DeltaSource(DataSource):
    """A stream of what is appended to the files of a folder. Options: path, glob, maxBytes (of one file in one batch, the newest win), splitBytes, staleMs, skipExisting.

    The offset maps each file to the end of its last whole line and a checksum of its first bytes. A file that is shorter than its offset, or whose
    first bytes have changed, is a new one and is read from 0. In every batch each file has one more row, without a line, whose status names any of
    rotated, truncated (bytes were skipped, the first partial line with them), pending (bytes after the last whole line wait for its end, or there
    is nothing new) and stale (not written for staleMs). A batch that is run again reads the bytes of its offsets again, which are gone if the file
    has been replaced meanwhile.
    """

    @classmethod
    def name(cls) -> str:
        return "tidelog_delta"

    def schema(self) -> str:
        return DELTA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _DeltaReader(self.options)


def whole_bytes(path: str, size: int, most: int) -> int:
    """Where the last whole line ends. A line of more than `most` bytes counts as whole where the file ends."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        high = size
        while high > max(0, size - most):
            low = max(0, high - CHUNK_BYTES)
            f.seek(low)
            cut = f.read(high - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            high = low
    return size if size > most else 0


def head_sum(path: str, length: int) -> int:
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        return zlib.crc32(f.read(length))


class _DeltaReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.most, self.split, self.stale = (int(options.get(k, v)) for k, v in (("maxBytes", DELTA_BYTES), ("splitBytes", SPLIT_BYTES), ("staleMs", STALE_MS)))
        self.skip = options.get("skipExisting", "false") == "true"

    def initialOffset(self):
        return self.latestOffset() if self.skip else {}

    def latestOffset(self):
        out = {}
        for path, size, _ in listed(self.path, self.glob):
            end = whole_bytes(path, size, self.most)
            length = min(HEAD_BYTES, end)
            out[path] = [end, length, head_sum(path, length)]
        return out

    def partitions(self, start, end):
        now, found = time.time() * 1000, {p: (size, written) for p, size, written in listed(self.path, self.glob)}
        out = []
        for path, (high, _, _) in sorted(end.items()):
            size, written = found.get(path, (high, now))
            since, length, head = start.get(path, (0, 0, 0))
            rotated = since > high or (length and path in found and head_sum(path, length) != head)
            since = 0 if rotated else since
            low = max(since, high - self.most)
            flags = [name for name, holds in (("rotated", rotated), ("truncated", low > since), ("pending", size > high or low == high), ("stale", now - written > self.stale)) if holds]
            out += ranges(path, low, high, self.split, low == since, since=since, status=())
            out.append(Range(path, high, high, high, True, since, tuple(flags), True))
        return out or [Range("", 0, 0, 0, True)]

    def read(self, partition):
        p = partition
        if p.report:
            yield (p.path, None, None, None, None, p.since, p.high, list(p.status))
        elif p.path:
            yield from _batches(p, (p.since, p.high, []))

    def commit(self, end):
        pass

    def stop(self):
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
    spark.dataSource.register(DeltaSource)


def read_tail(spark: SparkSession, path: str, tail_bytes: int = TAIL_BYTES, max_offset: int | dict[str, int] = 0, glob: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, offset, end, complete, line) of each file's last bytes below max_offset, without the line that the first of them cuts. A line that max_offset cuts is there, not complete."""
    register(spark)
    options = {"path": path, "glob": glob, "tailBytes": str(tail_bytes), "maxOffset": json.dumps(max_offset), "splitBytes": str(split_bytes)}
    return spark.read.format(TailSource.name()).options(**options).load()


def last_lines(spark: SparkSession, path: str, n: int = 40, max_offset: int | dict[str, int] = 0, glob: str = "*") -> DataFrame:
    """The last n lines of each file, of its last 64 KiB below max_offset."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("offset")))
    return read_tail(spark, path, LAST_LINES_BYTES, max_offset, glob).withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")


def last_records(spark: SparkSession, path: str, n: int = 20, max_offset: int | dict[str, int] = 0, glob: str = "*") -> DataFrame:
    """The last n lines of each file's last 64 KiB that hold a JSON object; others do not count."""
    rows = read_tail(spark, path, LAST_LINES_BYTES, max_offset, glob).filter(F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull())
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("offset")))
    return rows.withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")


def read_delta(spark: SparkSession, path: str, glob: str = "*", **options) -> DataFrame:
    """The stream of `DeltaSource`; options by their names there."""
    register(spark)
    return spark.readStream.format(DeltaSource.name()).options(path=path, glob=glob, **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def delta_lines(delta: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """A delta's lines without blank ones and those that hold one of the observer's own markers."""
    own = F.lit(False)
    for m in markers or []:
        own = own | F.contains("line", F.lit(m))
    return delta.filter(F.col("line").isNotNull() & (F.trim("line") != "") & ~own).drop("status")


def delta_status(delta: DataFrame) -> DataFrame:
    """(path, from_offset, new_offset, bytes_new, rotated, truncated, pending, stale) of each file in each batch."""
    has = lambda name: F.array_contains("status", name).alias(name)
    return delta.filter(F.col("offset").isNull()).select("path", "from_offset", "new_offset", (F.col("new_offset") - F.col("from_offset")).alias("bytes_new"), *[has(x) for x in ("rotated", "truncated", "pending", "stale")])


def with_offsets(texts: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line_no, offset, end, complete, line): the lines of texts in a table with the places that the readers of files give; `path` names a text. Lines are put in order within a text only."""
    lines = texts.filter(F.col(text) != "").select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("line_no", "_raw"), F.octet_length(text).cast("long").alias("_size"))
    spent = F.sum(F.octet_length("_raw").cast("long") + 1).over(Window.partitionBy("path").orderBy("line_no"))
    rows = lines.withColumn("end", spent).withColumn("offset", F.col("end") - F.octet_length("_raw") - 1).withColumn("complete", F.col("end") <= F.col("_size"))
    line = F.when(F.col("complete"), F.regexp_replace("_raw", "\r$", "")).otherwise(F.col("_raw"))
    return rows.filter(F.col("offset") < F.col("_size")).select("path", "line_no", "offset", F.least("end", "_size").alias("end"), "complete", line.alias("line"))


def window(lines: DataFrame, size: Column, tail_bytes: int = TAIL_BYTES, max_offset: int = 0) -> DataFrame:
    """Of lines with offsets those whole below max_offset (0: size) that start in the last tail_bytes bytes before it."""
    high = F.least(size, F.lit(max_offset)) if max_offset else size
    return lines.filter((F.col("end") <= high) & (F.col("offset") >= high - tail_bytes))
