"""op11: the transformation against lists of units, the round trip, and edges."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.llm import fim

SCHEMA = "doc_id long, text string, form string, meta map<string,int>"


def by_force(doc_id, text, unit=fim.LINES, rate=100, spm=50, seed=7, tags=fim.SENTINELS):
    text = text or ""
    units = re.findall(unit, text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(t in text for t in tags) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle = "".join(units[:a]), "".join(units[a:b])
    suffix = text[len(prefix) + len(middle) :]
    p, s, m = tags
    out = s + suffix + p + prefix + m + middle if h[3] % 100 < spm else p + prefix + s + suffix + m + middle
    return len(units), "spm" if h[3] % 100 < spm else "psm", out, len(prefix), len(middle)


def texts():
    rng = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "a\r\nb\r\n", "x<P>y\nz", "<S>", "<M>\n", "<\nP>\n<\nS>", "ünï\n\U0001f600\U0001f600\nz", "line\n" * 50_000, "w" * 300_000]
    return out + ["".join(rng.choice("ab<PSM>\n é") for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_equals_lists_of_units_and_comes_back(spark):
    rows = [(i, t, "mine", {"a": 1}) for i, t in enumerate(texts())] + [(None, "a\nb\nc\n", None, None), (7, "again\nand\n", None, None), (7, "again\nand\n", None, None), (-(1 << 62), "q\nr\n", "", {})]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fim.transform(docs)
    assert got.columns == ["doc_id", "text", "meta", "n", "form", "output", "prefix_chars", "middle_chars"]
    back = got.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[1] is None)
    for row, source in zip(sorted(back, key=lambda r: key((r["doc_id"], r["text"]))), sorted(rows, key=key)):
        assert (row["n"], row["form"], row["output"], row["prefix_chars"], row["middle_chars"]) == by_force(source[0], source[1])
        assert row["back"] == (source[1] or "") and row["meta"] == source[3]
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_other_units_rates_and_sentinels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:200])], "doc_id long, text string")
    options = {"unit": r"\s+|[^\s]+", "rate": 60, "spm": 20, "seed": 3, "sentinels": ("[pre]", "[suf]", "[mid]")}
    for row in fim.transform(docs, **options).collect():
        assert (row["n"], row["form"], row["output"], row["prefix_chars"], row["middle_chars"]) == by_force(row["doc_id"], row["text"], options["unit"], 60, 20, 3, options["sentinels"])
    got = fim.transform(docs, **options)
    assert got.filter(fim.restored(F.col("form"), F.col("output"), options["sentinels"]) != F.coalesce("text", F.lit(""))).count() == 0


@pytest.mark.parametrize("tags", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("aba", "cab", "x"), ("<P>", "<P>x", "y"), ("xyx", "a", "b")])
def test_sentinels_that_could_be_confused_are_refused(spark, tags):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=tags)


def test_empty_table_and_one_row(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(docs).count() == 0


def test_second_pass_stops_at_the_higher_rank():
    class Counting:
        def __init__(self):
            self.seen = 0

        def finditer(self, text):
            for m in re.finditer(fim.LINES, text):
                self.seen += 1
                yield m

    pattern = Counting()
    assert fim.cut_places(pattern, "a\n" * 1000, 2, 5) == (4, 10) and pattern.seen == 5
    assert fim.cut_places(pattern, "a\n" * 1000, 0, 0) == (0, 0)


def test_query_of_edges(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb\n", "x"), (None, None, None)], "doc_id long, text string, n string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in fim.op11_fill_in_middle(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[None]["n"], rows[None]["form"], rows[None]["output_sha256"], rows[None]["restored_sha256"]) == (0, "plain", empty, empty)
    assert rows[1]["restored_sha256"] == hashlib.sha256(b"a\nb\n").hexdigest()
