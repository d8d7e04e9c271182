"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        return str(v) if isinstance(v, str) else round(float(v), 4)

    cols = sorted(frame.columns)
    return sorted((tuple(value(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_window_filter_reaches_no_cartesian(spark):
    plan = catalogue.QUERIES["bookmark_context"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_token_report_has_every_document(spark, tmp_path):
    sizes = {1: None, 2: 10, 3: 2048, 4: 1048575, 5: 1048576, 6: 3 << 30, 7: 2 << 40}
    spark.createDataFrame(list(sizes.items()), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["tokens"], r["size"]) for r in catalogue.QUERIES["token_report"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, None), 2: (3, "10 B"), 3: (512, "2.0 KB"), 4: (262144, "1024.0 KB"), 5: (262144, "1.0 MB"), 6: (3 << 28, "3.0 GB"), 7: (2 << 38, "2.0 TB")}


def test_detect_format_finds_each_source(spark, tmp_path):
    from test_functions import GOLDEN

    golden = GOLDEN[:12]
    spark.createDataFrame([(i, name, f"{line}\n\n{line}") for i, (line, name, _) in enumerate(golden)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["detect_format"](spark, str(tmp_path)).collect()
    assert {(r["source"], r["adapter"]) for r in got} == {(name, name) for _, name, _ in golden}


FAILURES = [
    ("ok = no", "ok=false"), ("success: false", "success=false"), ("Failed=yes", "failed=true"), ("error=true", "error=true"), ("lost: 07", "non-zero failure count"), ("status=503", "http 4xx/5xx"),
    ("exit: -1", "non-zero exit code"), ("unable  to open", "failed to ..."), ("it timed out", "timed out"), ("timeout after 3 s", "timeout exceeded"), ("host unreachable", "connection refused"),
    ("errors=0 dropped=0 rc=0 status=200", None), ("errors=0 dropped=2", "non-zero failure count"), ("a calm line", None),
]


@pytest.fixture(scope="module")
def failing(spark, tmp_path_factory):
    """Documents and pages whose lines tell of every kind of failure and name addresses."""
    at = str(tmp_path_factory.mktemp("failing"))
    text = "\n".join(line for line, _ in FAILURES)
    spark.createDataFrame([(1, text), (2, "src=0x11111f dst=0x22222a\n\nsrc=0x11111f owner=0x33333b"), (3, None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, f"<p>{text}</p>"), (2, "<td>dst=0x33333b</td>\n<td>src=0x22222a</td>"), (3, None)], "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["text_severity", "text_severity_counts"])
def test_severity_of_documents_and_pages(spark, failing, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{failing}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, failing)
    assert rows(got.toPandas()) == rows(con.execute(catalogue.SQL[name]).df())
    if name == "text_severity":
        found = {(r["origin"], r["line_no"]): r["escalation_reason"] for r in got.filter("id = 1").collect()}
        assert found == {(o, i): reason for o in ("documents", "pages") for i, (_, reason) in enumerate(FAILURES)}


def test_roles_of_documents_and_pages(spark, failing):
    got = {(r["address"], r["role"]): r["n"] for r in catalogue.queries()["text_role_index"](spark, failing).collect()}
    assert got == {("0x11111f", "src"): 2, ("0x22222a", "dst"): 1, ("0x22222a", "src"): 1, ("0x33333b", "owner"): 1, ("0x33333b", "dst"): 1}
    assert [(r["address"], r["total"], r["roles"]) for r in catalogue.queries()["text_roles_never"](spark, failing).collect()] == [("0x11111f", 2, 1)]
