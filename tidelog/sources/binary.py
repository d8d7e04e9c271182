"""Packed binary logs as event rows: decoders, their registry, and two ways to read with them.

Layouts are the public ones of each format. Truncated or foreign data ends a file's rows, and never raises.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "log_path string, record long, ts_ms double, level string, source string, message string, data map<string,string>"
#: (ts_ms, level, source, message, data) of each record.
Rows = Iterator[tuple]
READERS: dict[str, Callable[[bytes, str], Rows]] = {}

# Layouts and names of the formats.
UTMP = struct.Struct("<h2xi32s4s32s256shhiii4i20x")
UTMP_TYPES = {1: "RUN_LVL", 2: "BOOT_TIME", 3: "NEW_TIME", 4: "OLD_TIME", 5: "INIT_PROCESS", 6: "LOGIN_PROCESS", 7: "USER_PROCESS", 8: "DEAD_PROCESS", 9: "ACCOUNTING"}
LASTLOG, FAILLOCK = struct.Struct("<i32s256s"), struct.Struct("<52sHHQ")
NETFLOW, FLOW = struct.Struct(">HHIIIIBBH"), struct.Struct(">IIIHHIIIIHHBBBBHHBBH")
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1e3), b"\xa1\xb2\xc3\xd4": (">", 1e3), b"\x4d\x3c\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e6)}
LINK_TYPES = {0: "null", 1: "ethernet", 101: "raw", 105: "802.11", 113: "linux_sll", 127: "radiotap", 276: "linux_sll2"}
MRT_TYPES = {11: "OSPFv2", 12: "TABLE_DUMP", 13: "TABLE_DUMP_V2", 16: "BGP4MP", 17: "BGP4MP_ET", 32: "ISIS", 33: "ISIS_ET", 48: "OSPFv3", 49: "OSPFv3_ET"}
UNIFIED2 = struct.Struct(">11I2H4B")
PROTOCOLS = {1: "icmp", 2: "igmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 58: "icmp6", 89: "ospf", 132: "sctp"}


def reader(name: str):
    """Register a decoder under a name; registering it again replaces it."""

    def add(f):
        READERS[name] = f
        return f

    return add


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _ip(n: int) -> str:
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _ms(seconds: float) -> float | None:
    """Epoch milliseconds from 1980 to 2100, else null."""
    return seconds * 1000.0 if 315532800 <= seconds < 4102444800 else None


def _fields(**values) -> dict[str, str]:
    return {k: str(v) for k, v in values.items() if v not in ("", None)}


@reader("utmp")
def utmp(data: bytes, path: str) -> Rows:
    """Login records; in a file of failed logins (btmp) they are warnings. Empty records are left out."""
    failed = "btmp" in os.path.basename(path)
    for at in range(0, len(data) - UTMP.size + 1, UTMP.size):
        kind, pid, line, _, user, host, *_rest = UTMP.unpack_from(data, at)
        if kind not in UTMP_TYPES:
            continue
        sec, usec = _rest[3], _rest[4]
        name = UTMP_TYPES[kind]
        yield _ms(sec + usec / 1e6), "WARN" if failed else "INFO", "btmp" if failed else "utmp", f"{name} {_text(user)} {_text(line)} {_text(host)}".strip(), _fields(type=name, pid=pid, user=_text(user), line=_text(line), host=_text(host))


@reader("lastlog")
def lastlog(data: bytes, path: str) -> Rows:
    """Last logins by uid, the record's place in the file; unused places are left out."""
    for uid in range(len(data) // LASTLOG.size):
        when, line, host = LASTLOG.unpack_from(data, uid * LASTLOG.size)
        if when:
            yield _ms(when), "INFO", "lastlog", f"uid {uid} last login {_text(line)} {_text(host)}".strip(), _fields(uid=uid, line=_text(line), host=_text(host))


@reader("faillock")
def faillock(data: bytes, path: str) -> Rows:
    """Valid tallies of failed logins; the file is named after the user."""
    for at in range(0, len(data) - FAILLOCK.size + 1, FAILLOCK.size):
        source, _, status, when = FAILLOCK.unpack_from(data, at)
        if status & 1:
            kind = "rhost" if status & 2 else "tty" if status & 4 else "service"
            yield _ms(when), "WARN", "faillock", f"failed login of {os.path.basename(path)} from {_text(source)}", _fields(user=os.path.basename(path), origin=_text(source), kind=kind)


@reader("wtmpdb")
def wtmpdb(data: bytes, path: str) -> Rows:
    """Login databases in SQLite: the tables wtmp and Lastlog2."""
    if not data.startswith(b"SQLite format 3\0"):
        return
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(data)
        f.flush()
        try:
            con = sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True)
            tables = {r[0].lower() for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            if "wtmp" in tables:
                for user, login, logout, tty, host in con.execute("SELECT User, Login, Logout, TTY, RemoteHost FROM wtmp ORDER BY Login"):
                    yield _ms(flexible_seconds(login)), "INFO", "wtmpdb", f"{user or ''} {tty or ''} {host or ''}".strip(), _fields(user=user, tty=tty, host=host, logout=logout)
            if "lastlog2" in tables:
                for user, when, tty, host in con.execute("SELECT Name, Time, TTY, RemoteHost FROM Lastlog2 ORDER BY Time"):
                    yield _ms(flexible_seconds(when)), "INFO", "lastlog2", f"{user or ''} {tty or ''} {host or ''}".strip(), _fields(user=user, tty=tty, host=host)
            con.close()
        except sqlite3.Error:
            return


def flexible_seconds(value) -> float:
    """A time in s, ms or us as seconds, by its size; 0 for none."""
    v = float(value or 0)
    return v / 1e6 if v > 1e14 else v / 1e3 if v > 1e11 else v


@reader("netflow_v5")
def netflow_v5(data: bytes, path: str) -> Rows:
    """One row a flow; its time is the export's clock less the uptime since the flow began."""
    at = 0
    while at + NETFLOW.size <= len(data):
        version, count, uptime, secs, nsecs, *_ = NETFLOW.unpack_from(data, at)
        if version != 5:
            return
        at += NETFLOW.size
        for _i in range(count):
            if at + FLOW.size > len(data):
                return
            src, dst, _, _, _, packets, octets, first, last, sport, dport, _, flags, proto, *_ = FLOW.unpack_from(data, at)
            at += FLOW.size
            name = PROTOCOLS.get(proto, str(proto))
            yield _ms(secs + nsecs / 1e9 - (uptime - first) / 1e3), "INFO", "netflow", f"{_ip(src)}:{sport} -> {_ip(dst)}:{dport} {name} {packets} packets {octets} bytes", _fields(src=_ip(src), dst=_ip(dst), sport=sport, dport=dport, protocol=name, packets=packets, bytes=octets, duration_ms=last - first, tcp_flags=flags)


@reader("pcap")
def pcap(data: bytes, path: str) -> Rows:
    """One row a packet: lengths and link type, no payload."""
    if len(data) < 24 or data[:4] not in PCAP:
        return
    order, per_ms = PCAP[data[:4]]
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(data):
        sec, part, kept, length = struct.unpack_from(order + "IIII", data, at)
        at += 16 + kept
        if at > len(data):
            return
        yield _ms(sec + part / per_ms / 1e3), "INFO", "pcap", f"packet of {length} bytes", _fields(captured=kept, length=length, link=LINK_TYPES.get(link, link))


@reader("mrt")
def mrt(data: bytes, path: str) -> Rows:
    """Routing dumps, one row a record; extended types carry microseconds."""
    at = 0
    while at + 12 <= len(data):
        sec, kind, sub, length = struct.unpack_from(">IHHI", data, at)
        at += 12
        if at + length > len(data) or kind not in MRT_TYPES:
            return
        micro = struct.unpack_from(">I", data, at)[0] if kind in (17, 33, 49) and length >= 4 else 0
        at += length
        yield _ms(sec + micro / 1e6), "INFO", "mrt", f"{MRT_TYPES[kind]} subtype {sub} of {length} bytes", _fields(type=MRT_TYPES[kind], subtype=sub, length=length)


@reader("unified2")
def unified2(data: bytes, path: str) -> Rows:
    """Intrusion events (types 7 and 104); other records are skipped."""
    at = 0
    while at + 8 <= len(data):
        kind, length = struct.unpack_from(">II", data, at)
        at += 8
        if at + length > len(data):
            return
        if kind in (7, 104) and length >= UNIFIED2.size:
            sensor, event, sec, micro, sid, gid, rev, cls, priority, src, dst, sport, dport, proto, _, _, blocked = UNIFIED2.unpack_from(data, at)
            level = "ERROR" if priority == 1 else "WARN" if priority == 2 else "INFO"
            name = PROTOCOLS.get(proto, str(proto))
            yield _ms(sec + micro / 1e6), level, "unified2", f"[{gid}:{sid}:{rev}] {_ip(src)}:{sport} -> {_ip(dst)}:{dport} {name}", _fields(sensor=sensor, event=event, sid=sid, gid=gid, rev=rev, classification=cls, priority=priority, src=_ip(src), dst=_ip(dst), sport=sport, dport=dport, protocol=name, blocked=blocked)
        at += length


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Records of all files under a path that Spark can list, local or remote; one file is one task's work."""
    decode = READERS[name]

    def run(frames):
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"]):
                rows = [(p, i, *r) for i, r in enumerate(decode(bytes(content), p))]
                yield pd.DataFrame(rows, columns=["log_path", "record", "ts_ms", "level", "source", "message", "data"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, SCHEMA)


class _File(InputPartition):
    pass


class BinaryLogSource(DataSource):
    """spark.read.format("tidelog_binary").option("reader", name).load(path), for files that the executors can open."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_binary"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.decoder, self.path = options["reader"], options["path"]

    def partitions(self):
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs)
        return [_File(f) for f in files]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for i, row in enumerate(READERS[self.decoder](f.read(), partition.value)):
                yield (partition.value, i, *row)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinaryLogSource)
