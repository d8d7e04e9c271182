"""Byte ranges of files and streams of what is appended to them, against Python's own reading."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.sources import tail


def lines_by_force(data: bytes, low: int, high: int):
    """(offset, end, complete, line) of the lines that start in [low, high)."""
    out, at = [], 0
    while at < high:
        cut = data.find(b"\n", at, high)
        end = cut + 1 if cut >= 0 else high
        line = data[at : cut if cut >= 0 else high]
        if at >= low:
            out.append((at, end, cut >= 0, (line[:-1] if cut >= 0 and line.endswith(b"\r") else line).decode("utf-8", "replace")))
        at = end
    return out


def some_bytes(seed, n=400):
    rng = random.Random(seed)
    pieces = [b"", b"plain", "ünï€\U0001f600".encode(), b"\xff\xfe", b"tab\tx", b"cr\rin", b"x" * rng.randint(1, 300)]
    data = b"".join(rng.choice(pieces) + rng.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(n))
    return data + rng.choice([b"", b"no end", "é".encode()[:1], b"\r"])


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_each_line_once_with_its_place(tmp_path, seed, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK_BYTES", 37)
    data, path = some_bytes(seed), str(tmp_path / "a.log")
    (tmp_path / "a.log").write_bytes(data)
    rng = random.Random(seed)
    for _ in range(40):
        high = rng.randint(0, len(data))
        low = rng.choice([0, rng.randint(0, high)])
        split = rng.choice([1, 7, 64, 1000, 1 << 20])
        if split == 1 and high - low > 300:
            split = 5
        got = [(a, b, c, x.decode("utf-8", "replace")) for r in tail.ranges(path, low, high, split, low == 0) for a, b, c, x in tail.lines_in(r)]
        assert got == lines_by_force(data, low, high)


def test_reads_no_more_than_the_window(tmp_path, monkeypatch):
    path = str(tmp_path / "a.log")
    (tmp_path / "a.log").write_bytes(b"0123456789\n" * 100_000)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    plain = tail._opened

    class System:
        def open_input_file(self, p):
            return Counted(plain(path)[0].open_input_file(p))

    monkeypatch.setattr(tail, "_opened", lambda p: (System(), p))
    (part,) = tail.ranges(path, 1_000_000, 1_050_000, 1 << 20, False)
    assert len(list(tail.lines_in(part))) == 4545 and sum(read) <= 50_000 + 2


def test_tail_of_files(spark, tmp_path):
    rng = random.Random(4)
    want = set()
    for i in range(5):
        data = some_bytes(20 + i, rng.choice([0, 3, 200]))
        (tmp_path / f"{i}.log").write_bytes(data)
        low = max(0, len(data) - 3000)
        want |= {(f"{i}.log", *x) for x in lines_by_force(data, low, len(data))}
    (tmp_path / "other.bin").write_bytes(b"no\n")
    rows = tail.read_tail(spark, str(tmp_path), 3000, glob="*.log", split_bytes=700).collect()
    assert len(rows) == len(want) and {(os.path.basename(r["path"]), *r[1:]) for r in rows} == want
    path = str(tmp_path / "2.log")
    size = os.path.getsize(path)
    pinned = tail.read_tail(spark, path, 100, {path: size // 2}).collect()
    assert [tuple(r[1:]) for r in pinned] == lines_by_force(open(path, "rb").read(), size // 2 - 100, size // 2)
    assert tail.read_tail(spark, str(tmp_path / "none")).count() == 0
    assert tail.read_tail(spark, f"file://{path}", 0).count() == len(lines_by_force(open(path, "rb").read(), 0, size))


def test_last_lines_and_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join('{"i": %d}\n' % i + ("broken {\n" if i % 2 else "") for i in range(100)))
    got = sorted(r["line"] for r in tail.last_lines(spark, str(tmp_path), 3).collect())
    assert got == sorted(['{"i": 99}', "broken {", '{"i": 98}'])
    assert sorted(r["line"] for r in tail.last_records(spark, str(tmp_path), 3).collect()) == ['{"i": 97}', '{"i": 98}', '{"i": 99}']


def run(spark, source, out, checkpoint):
    query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_delta_appends_rotates_truncates_and_resumes(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"
    seen = set()

    def step():
        """Lines and status rows that are new."""
        run(spark, tail.read_delta(spark, str(folder), maxBytes=1000, splitBytes=64), out, checkpoint)
        rows = spark.read.parquet(out).withColumn("file", F.regexp_extract("path", "[^/]+$", 0)).collect()
        fresh = [r for r in rows if tuple(map(str, r)) not in seen]
        seen.update(tuple(map(str, r)) for r in fresh)
        return sorted((r["file"], r["offset"], r["line"]) for r in fresh if r["offset"] is not None), {r["file"]: (r["from_offset"], r["new_offset"], sorted(r["status"])) for r in fresh if r["offset"] is None}

    a.write_bytes("eins\nzwei é\nhal".encode())
    b.write_bytes(b"")
    lines, status = step()
    assert lines == [("a.log", 0, "eins"), ("a.log", 5, "zwei é")] and status == {"a.log": (0, 13, ["pending"]), "b.log": (0, 0, ["pending"])}
    with a.open("ab") as f:
        f.write(b"f\nmore\n")
    b.write_bytes(b"first\n")
    lines, status = step()  # a new query from the same checkpoint: the open line is whole now, and nothing comes twice
    assert lines == [("a.log", 13, "half"), ("a.log", 18, "more"), ("b.log", 0, "first")] and status["a.log"] == (13, 23, [])
    a.write_bytes(b"new\n")  # shorter: a new file
    lines, status = step()
    assert lines == [("a.log", 0, "new")] and status["a.log"] == (0, 4, ["rotated"])
    b.write_bytes(b"SECOND and longer than before\n")  # longer, but not the file that it was
    lines, status = step()
    assert lines == [("b.log", 0, "SECOND and longer than before")] and status["b.log"] == (0, 30, ["rotated"])
    with a.open("ab") as f:
        f.write(b"".join(b"%04d\n" % i for i in range(1000)))
    lines, status = step()  # 5000 bytes, of which the last 1000 are taken
    assert [x[2] for x in lines] == [f"{i:04}" for i in range(800, 1000)] and status["a.log"] == (4, 5004, ["truncated"])
    old = 1_600_000_000
    os.utime(b, (old, old))
    with a.open("ab") as f:
        f.write(b"\nlast\n")
    lines, status = step()
    assert [x[2] for x in lines] == ["", "last"] and status["b.log"] == (30, 30, ["pending", "stale"])


def test_delta_lines_and_status(spark):
    rows = [("p", 0, 2, True, " ", 0, 9, []), ("p", 2, 5, True, "hello", 0, 9, []), ("p", 5, 9, True, "[own] x", 0, 9, []), ("p", None, None, None, None, 0, 9, ["stale", "rotated"])]
    delta = spark.createDataFrame(rows, tail.DELTA)
    assert [r["line"] for r in tail.delta_lines(delta, ["[own]"]).collect()] == ["hello"]
    assert [tuple(r) for r in tail.delta_status(delta).collect()] == [("p", 0, 9, 9, True, False, False, True)]


def test_offsets_of_texts_equal_those_of_files(spark):
    texts = [some_bytes(i, 30).decode("utf-8", "replace") for i in range(20)] + ["", "\n", "x", "x\n", None]
    got = tail.with_offsets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()
    want = {(i, *x) for i, t in enumerate(texts) for x in lines_by_force((t or "").encode(), 0, len((t or "").encode()))}
    assert {(r["path"], r["offset"], r["end"], r["complete"], r["line"]) for r in got} == want and len(got) == len(want)


def test_logs_by_conventional_names(spark):
    from tidelog.sources import text

    paths = ["/var/log/syslog", "/var/log/syslog.1", "/var/log/messages-20240101", "/srv/catalina.out", "/srv/nohup.out", "/x/app.log", "/x/readme", "/x/kernel_notes.md", "/opt/syslog.py"]
    got = {r["path"] for r in text.log_candidates(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == set(paths[:6])


def test_events_of_a_tail(spark, tmp_path):
    from tidelog.operators import parsing

    log4j = "2024-01-05 10:00:{0:02},123 [main] WARN app.Svc - event {0}"
    (tmp_path / "a.log").write_text("".join(log4j.format(i) + "\n" for i in range(50)))
    (tmp_path / "b.log").write_text("".join('{"ts": "2024-01-05T10:00:%02dZ", "level": 50, "msg": "bad %d"}\n' % (i, i) for i in range(30)))
    size = len(log4j.format(10)) + 1
    rows = parsing.tail_events(spark, str(tmp_path), "mine", tail_bytes=10 * size).collect()
    a = sorted((r["offset"], r["message"], r["level"], r["adapter"]) for r in rows if r["log_path"].endswith("a.log"))
    assert [x[1:] for x in a] == [(f"event {i}", "WARN", "log4j") for i in range(40, 50)] and a[0][0] == os.path.getsize(tmp_path / "a.log") - 10 * size
    assert {(r["level"], r["adapter"], r["log_label"]) for r in rows if r["log_path"].endswith("b.log")} == {("ERROR", "jsonl", "mine")}
    path = str(tmp_path / "a.log")
    pinned = parsing.tail_events(spark, path, max_offset={path: 5 * (size - 1)}, adapter="log4j").collect()
    assert [r["message"] for r in sorted(pinned, key=lambda r: r["offset"])] == [f"event {i}" for i in range(5)]
    assert {r["adapter"] for r in parsing.tail_events(spark, path, adapter="no such").collect()} <= set(parsing.FALLBACK)


def test_frames_with_unknown_and_missing_keys(spark):
    from tidelog import schema

    rows = spark.createDataFrame([('{"sequence": 3, "summary": "s", "never_seen": {"a": 1}}',), ("no json",), (None,)], "t string")
    got = [r["f"] for r in rows.select(schema.load_frame(F.col("t")).alias("f")).collect()]
    assert got[0]["sequence"] == 3 and got[0]["summary"] == "s" and got[0]["tags"] is None and (got[1] is None or got[1]["sequence"] is None) and got[2] is None
