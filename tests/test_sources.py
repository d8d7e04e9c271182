import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.sources import binary, text


def utmp_record(kind=7, user=b"ann"):
    return binary.UTMP.pack(kind, 12, b"pts/0", b"id", user, b"host", 0, 0, 1, 1704164645, 500000, 0, 0, 0, 0)


def sample(name: str, tmp) -> bytes:
    if name == "utmp":
        return utmp_record() + utmp_record(0)
    if name == "lastlog":
        return binary.LASTLOG.pack(0, b"", b"") + binary.LASTLOG.pack(1704164645, b"tty1", b"h")
    if name == "faillock":
        return binary.FAILLOCK.pack(b"10.0.0.1", 0, 3, 1704164645) + binary.FAILLOCK.pack(b"x", 0, 0, 1)
    if name == "wtmpdb":
        path = tmp / "x.db"
        con = sqlite3.connect(path)
        con.execute("CREATE TABLE wtmp (ID INTEGER, Type INTEGER, User TEXT, Login INTEGER, Logout INTEGER, TTY TEXT, RemoteHost TEXT, Service TEXT)")
        con.execute("INSERT INTO wtmp VALUES (1, 3, 'ann', 1704164645000000, NULL, 'tty1', 'h', 'sshd')")
        con.commit()
        con.close()
        return path.read_bytes()
    if name == "netflow_v5":
        return binary.NETFLOW.pack(5, 1, 10000, 1704164645, 0, 1, 0, 0, 0) + binary.FLOW.pack(0x0A000001, 0x0A000002, 0, 1, 2, 3, 400, 9000, 9500, 1234, 80, 0, 2, 6, 0, 0, 0, 0, 0, 0)
    if name == "pcap":
        return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1704164645, 500000, 4, 60) + b"abcd"
    if name == "mrt":
        return struct.pack(">IHHI", 1704164645, 17, 4, 8) + struct.pack(">I", 250000) + b"abcd"
    return struct.pack(">II", 7, 52) + binary.UNIFIED2.pack(1, 2, 1704164645, 0, 1000, 1, 2, 3, 1, 0x0A000001, 0x0A000002, 1234, 80, 6, 0, 0, 1)


@pytest.mark.parametrize("name", sorted(binary.READERS))
def test_decodes_and_survives(name, tmp_path):
    data = sample(name, tmp_path)
    rows = list(binary.READERS[name](data, "/var/log/btmp"))
    assert len(rows) == 1 and rows[0][0] is not None and rows[0][0] >= 1704164635000.0
    for broken in (b"", data[: len(data) // 2], b"\x00\xff" * 300):
        list(binary.READERS[name](broken, "x"))


def test_reads_files_and_data_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "wtmp").write_bytes(utmp_record() * 3)
    assert binary.read(spark, "utmp", str(tmp_path / "d")).count() == 3
    binary.register(spark)
    got = spark.read.format("tidelog_binary").option("reader", "utmp").load(str(tmp_path / "d"))
    assert got.count() == 3 and got.first()["data"]["user"] == "ann"


def test_text_reports(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    assert one(text.key_values(F.col("t")), "| Frame Time: 16 ms |\nFPS: 60\nFPS: 61") == {"frame_time": "16 ms", "fps": "61"}
    assert one(text.test_summary(F.col("t")), "== 3 passed, 1 failed in 2s")[0:2] == (3, 1)
    lsof = spark.createDataFrame([("app 12 me 3w REG 8,1 10 99 /var/log/a.log",), ("app 12 me 4r REG 8,1 10 99 /x",)], "l string")
    assert [tuple(r) for r in text.write_targets(lsof, "l").collect()] == [(12, "/var/log/a.log")]


def test_files_and_census(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n")
    (tmp_path / "app.log").write_text("x\n")
    listing = text.files(spark, str(tmp_path))
    assert {r["language"] for r in listing.collect()} == {"python", None}
    assert text.log_candidates(listing).count() == 1
