"""Queries over places in files, predicates held in tables, records of several lines, exact medians, trees and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codesigns, text
from ..operators import hardware, predicates, ranks, records, timeline, trees
from ..sources import tail
from .catalogue import DOC_LINES, document_lines, query, table

_PLACES = """raw AS (SELECT doc_id, strlen(text) AS size, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''),
summed AS (SELECT doc_id, size, l, line_no, sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS e FROM raw),
places AS (SELECT doc_id, line_no, size, CAST(e - strlen(l) - 1 AS BIGINT) AS "offset", CAST(least(e, size) AS BIGINT) AS "end", e <= size AS complete, CASE WHEN e <= size THEN regexp_replace(l, '\\r$', '') ELSE l END AS line FROM summed WHERE e - strlen(l) - 1 < size)"""


@query(f'WITH {_PLACES} SELECT doc_id, line_no, "offset", "end" FROM places WHERE "end" <= 2048')
def pinned_offset(spark, sf_dir):
    """Each document as a file: the lines that were whole when it had 2,048 bytes."""
    places = tail.with_offsets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return timeline.up_to_offset(places, 2048).select(F.col("path").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "offset", "end")


@query(f"""WITH {_PLACES}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "offset" DESC) AS r FROM places WHERE "end" <= size AND "offset" >= size - 1024)
SELECT doc_id, "offset", complete, line FROM w WHERE r <= 5""")
def document_tails(spark, sf_dir):
    """The last five lines of each document's last 1,024 bytes, without the line that the first of them cuts."""
    d = table(spark, sf_dir, "documents")
    places = tail.with_offsets(d, "doc_id", "text").join(d.select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size")), "path")
    last = tail.window(places, F.col("size"), 1024)
    found = last.groupBy("path").agg(F.slice(F.sort_array(F.collect_list(F.struct("offset", "complete", "line")), asc=False), 1, 5).alias("l"))
    return found.select(F.col("path").alias("doc_id"), F.explode("l").alias("l")).select("doc_id", "l.offset", "l.complete", "l.line")


_WATCHES = """watches AS (SELECT 'item_' || item_id AS name, CASE WHEN item_id % 4 = 3 THEN 'src' || (item_id % 20) END AS source, array_to_string(string_split(text, ' ')[1:5], ' ') AS phrase FROM benchmark)"""


def _watch_hits(spark, sf_dir) -> DataFrame:
    """Lines of documents against a watch for the first five words of every benchmark item, some of them in one source only."""
    lines = document_lines(spark, sf_dir).withColumns({"category": F.lit("text"), "level": F.lit("INFO")})
    i = F.col("item_id")
    phrase = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    quoted = F.regexp_replace(phrase, r"([^\w\s])", r"\\$1")
    watches = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), i.cast("string")).alias("name"), F.lit("").alias("category"), F.lit(None).cast("string").alias("level"), F.when(i % 4 == 3, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("source"), quoted.alias("regex"))
    return predicates.watch_hits(lines, watches, ["doc_id", "line_no"], "line")


@query(f"WITH {DOC_LINES}, {_WATCHES} SELECT doc_id, line_no, name AS watch FROM dl JOIN watches ON contains(lower(line), lower(phrase)) AND (watches.source IS NULL OR watches.source = dl.source)")
def watch_table_hits(spark, sf_dir):
    return _watch_hits(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "watch")


@query(f"WITH {DOC_LINES}, {_WATCHES} SELECT name AS watch, count(*) AS hits, min(doc_id) AS first_ms, max(doc_id) AS last_ms FROM dl JOIN watches ON contains(lower(line), lower(phrase)) AND (watches.source IS NULL OR watches.source = dl.source) GROUP BY 1")
def watch_table_totals(spark, sf_dir):
    """Hits of each watch with the first and last document."""
    return predicates.watch_totals(_watch_hits(spark, sf_dir), "doc_id")


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS signal, url, len(regexp_extract_all(html, '(?im){_sql_text(p)}')) AS n FROM pages" for k, p in codesigns.SIGNALS.items()) + ") SELECT signal, CAST(sum(n) AS BIGINT) AS hits, count(*) AS files, min(url) AS example FROM c WHERE n > 0 GROUP BY 1")
def code_signal_hits(spark, sf_dir):
    """The whole vocabulary of code signals over the sources of all pages."""
    return predicates.signal_report(table(spark, sf_dir, "pages"), "url", "html", codesigns.SIGNALS)


_LETTER = "CASE event_type WHEN 'error' THEN 'E' WHEN 'signup' THEN 'W' ELSE 'I' END"
_RECORDS = f"""r AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) // 1000000 * 1000 AS DOUBLE) AS sec_ms, epoch_us(ts) / 1000.0::DOUBLE AS ms, user_id % 5 AS f,
  CASE WHEN user_id % 5 = 0 THEN 'all' ELSE 'user_' || user_id END AS file FROM events),
expected AS (SELECT file, event_id, (['logcat_long', 'slow_query', 'journal_export', 'commit_log', 'python_trace'])[f + 1] AS format,
  CASE f WHEN 0 THEN (CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END) WHEN 2 THEN (CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END) WHEN 4 THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE f WHEN 0 THEN event_type WHEN 1 THEN 'u' || user_id WHEN 2 THEN event_type WHEN 3 THEN 'user ' || user_id ELSE 'app.' || event_type END AS source,
  CASE f WHEN 0 THEN 'value ' || event_id || chr(10) || 'kept ' || user_id WHEN 1 THEN 'SELECT * FROM t' || chr(10) || 'WHERE id = ' || event_id || ';' WHEN 2 THEN 'value ' || event_id WHEN 3 THEN 'fix ' || event_id ELSE 'ValueError: bad ' || event_id END AS message,
  CASE f WHEN 2 THEN ms ELSE sec_ms END AS ts_ms, CAST(([4, 5, 5, 5, 5])[f + 1] AS BIGINT) AS lines FROM r)"""


def record_lines(spark, sf_dir) -> DataFrame:
    """(file, line_no, line): events written as records of five formats; one file holds a fifth of all events, the others one user's each."""
    e, us = table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    at = lambda p: F.date_format(F.col("ts").cast("timestamp"), p)
    n, u, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    letter = F.when(kind == "error", "E").when(kind == "signup", "W").otherwise("I")
    texts = [
        F.concat(F.lit("[ "), at("MM-dd HH:mm:ss"), F.lit(".000  "), u, F.lit(": "), n, F.lit(" "), letter, F.lit("/"), kind, F.lit(" ]\nvalue "), n, F.lit("\nkept "), u, F.lit("\n")),
        F.concat(F.lit("# Time: "), at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z\n# User@Host: u"), u, F.lit("[u] @ localhost []\n# Query_time: 1.5\nSELECT * FROM t\nWHERE id = "), n, F.lit(";")),
        F.concat(F.lit("__CURSOR=s=ab;i="), n, F.lit("\n__REALTIME_TIMESTAMP="), us.cast("string"), F.lit("\nPRIORITY="), F.when(kind == "error", "3").when(kind == "signup", "4").otherwise("6"), F.lit("\nSYSLOG_IDENTIFIER="), kind, F.lit("\nMESSAGE=value "), n),
        F.concat(F.lit("commit "), F.sha1(n.cast("binary")), F.lit("\nAuthor: user "), u, F.lit(" <u@example.org>\nDate:   "), at("EEE MMM d HH:mm:ss yyyy"), F.lit(" +0000\n\n    fix "), n),
        F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(",000 ERROR app."), kind, F.lit(" failed\nTraceback (most recent call last):\n  File \"/a/b.py\", line 3, in run\n    go()\nValueError: bad "), n),
    ]
    file = F.when(F.col("user_id") % 5 == 0, "all").otherwise(F.concat(F.lit("user_"), u))
    text = F.element_at(F.array(*texts), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(file.alias("file"), F.col("event_id"), F.posexplode(F.split(text, "\n")).alias("i", "line")).select("file", (F.col("event_id") * 8 + F.col("i")).alias("line_no"), "line")


@query(f"WITH {_RECORDS} SELECT DISTINCT file, format, CASE format WHEN 'python_trace' THEN 0.85 ELSE 1.0 END::DOUBLE AS score FROM expected")
def multiline_formats(spark, sf_dir):
    return records.detected(record_lines(spark, sf_dir), ["file"], "line_no", "line")


@query(f"WITH {_RECORDS} SELECT file, format, event_id * 8 AS first, lines, level, source, message, ts_ms FROM expected")
def multiline_records(spark, sf_dir):
    lines = record_lines(spark, sf_dir)
    found = records.parsed(lines, records.detected(lines, ["file"], "line_no", "line"), ["file"], "line_no", "line")
    return records.times(found).select("file", "format", "first", "lines", "level", "source", "message", "ts_ms")


@query("SELECT event_type, round(median(value), 9) AS median FROM events GROUP BY 1 UNION ALL SELECT NULL, round(median(value), 9) FROM events")
def hot_medians(spark, sf_dir):
    """Exact medians of few keys with very many rows, and of one key that holds them all."""
    e = table(spark, sf_dir, "events")
    whole = ranks.medians(e.withColumn("k", F.lit(1)), ["k"], "value").select(F.lit(None).cast("string").alias("event_type"), "median")
    return ranks.medians(e, ["event_type"], "value").unionByName(whole).select("event_type", F.round("median", 9).alias("median"))




def _grey(i: str = "x") -> str:
    return f"greatest(least(CAST(floor(128 + 64 * CAST({i} AS DOUBLE)) AS INTEGER), 255), 0)"


_CELLS = f"""cells AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, {_grey("embedding[i + 1]")} AS grey FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""


def greys() -> F.Column:
    """An embedding's components as shades."""
    return F.transform("embedding", lambda x: F.greatest(F.least(F.floor(128 + 64 * x.cast("double")).cast("int"), F.lit(255)), F.lit(0)))


_SHARE = "(log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 4"


def _level_sql(side: int) -> str:
    return f"l{side} AS (SELECT vec_id, x, y, round({_SHARE}, 9) AS e FROM (SELECT vec_id, x // {side} * {side} AS x, y // {side} * {side} AS y, grey // 16 AS shade, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL)"


@query(f"""WITH {_CELLS}, {", ".join(map(_level_sql, (8, 4, 2)))},
s8 AS (SELECT * FROM l8), s4 AS (SELECT l4.* FROM l4 JOIN s8 ON l4.vec_id = s8.vec_id AND s8.e > 0.35), s2 AS (SELECT l2.* FROM l2 JOIN s4 ON l2.vec_id = s4.vec_id AND l2.x // 4 * 4 = s4.x AND l2.y // 4 * 4 = s4.y AND s4.e > 0.35)
SELECT vec_id, x, y, 8 AS side, e AS entropy FROM s8 WHERE e <= 0.35 UNION ALL SELECT vec_id, x, y, 4, e FROM s4 WHERE e <= 0.35 UNION ALL SELECT vec_id, x, y, 2, e FROM s2""")
def grid_regions(spark, sf_dir):
    """The quadtree of every embedding seen as an image of 8 x 8 shades."""
    cells = trees.grid_cells(table(spark, sf_dir, "embeddings"), "vec_id", greys(), 8)
    found = trees.quadtree(cells, ["vec_id"], 8, max_depth=2)
    return found.select("vec_id", *[F.col(c).cast("long").alias(c) for c in "xy"], "side", "entropy")


@query(f"""WITH p AS (SELECT vec_id, {_grey("embedding[3 * i + 1]")} // 16 AS r, {_grey("embedding[3 * i + 2]")} // 16 AS g, {_grey("embedding[3 * i + 3]")} // 16 AS b FROM (SELECT vec_id, embedding, unnest(range(21)) AS i FROM embeddings)),
c AS (SELECT vec_id, r, g, b, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT *, round(n / sum(n) OVER (PARTITION BY vec_id), 4) AS share, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, r, g, b) AS rank FROM c)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, r, g, b, n, share FROM k WHERE rank <= 3""")
def dominant_colours(spark, sf_dir):
    """The three most frequent colours of every embedding seen as 21 pixels."""
    shades = table(spark, sf_dir, "embeddings").select("vec_id", greys().alias("s"))
    pixels = shades.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*[F.get("s", 3 * i + j).alias(c) for j, c in enumerate("rgb")]))).alias("p")).select("vec_id", "p.*")
    return trees.dominant_colours(pixels, ["vec_id"]).select("vec_id", "rank", "r", "g", "b", "n", "share")


def order_trees(spark, sf_dir, text) -> DataFrame:
    """(o_orderkey, tree): each order as a group of its lines as buttons, some invisible, some without size or text; every second group has a text."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.struct(F.lit("button").alias("role"), text.alias("text"), (F.col("l_returnflag") != "R").alias("visible"), F.array(F.col("l_linenumber") * 8, F.lit(0), F.col("l_linenumber") % 4, F.lit(5)).alias("bbox")).alias("node")).alias("n"))
    of = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["node"]).alias("children"))
    orders = table(spark, sf_dir, "orders").join(of, F.col("o_orderkey") == F.col("l_orderkey"))
    group = F.struct(F.lit("Group").alias("role"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("text"), F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("bbox"), "children")
    return orders.select("o_orderkey", F.to_json(F.array(group)).alias("tree"))


_SHOWN = """shown AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND l_linenumber % 4 <> 0)"""


@query(f"""WITH {_SHOWN} SELECT CAST(o_orderkey AS VARCHAR) AS id, 0 AS depth, 'Group' AS role, o_orderpriority AS text, 0.0::DOUBLE AS x, 10.0::DOUBLE AS w FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT CAST(k AS VARCHAR), CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, 'button', 'part ' || l_partkey, l_linenumber * 8.0::DOUBLE, CAST(l_linenumber % 4 AS DOUBLE) FROM shown WHERE l_linenumber % 3 <> 0""")
def interface_nodes(spark, sf_dir):
    """Orders as interface trees, pruned and laid out as rows."""
    found = trees.flatten(order_trees(spark, sf_dir, F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))), "o_orderkey", "tree")
    return found.select("id", "depth", "role", "text", "x", "w")


@query(f"""WITH {_SHOWN}, b AS (SELECT k, l_linenumber AS cx, min('no ' || l_partkey) AS before FROM shown WHERE l_linenumber % 3 <> 0 GROUP BY ALL), a AS (SELECT k, l_linenumber AS cx, min('no ' || l_suppkey) AS after FROM shown WHERE l_linenumber % 5 <> 0 GROUP BY ALL)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS id, CAST(coalesce(a.cx, b.cx) AS BIGINT) AS cx, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change, before, after FROM a FULL JOIN b ON a.k = b.k AND a.cx = b.cx WHERE before IS NULL OR after IS NULL OR before <> after""")
def interface_changes(spark, sf_dir):
    """What changed between two looks at each order's tree."""
    at = lambda n, c: trees.flatten(order_trees(spark, sf_dir, F.when(F.col("l_linenumber") % n == 0, "").otherwise(F.concat(F.lit("no "), F.col(c).cast("string")))), "o_orderkey", "tree")
    return trees.tree_diff(at(3, "l_partkey"), at(5, "l_suppkey"), ["id"]).filter("role = 'button'").select("id", "cx", "change", "before", "after")


@query("""WITH l AS (SELECT 'user_' || user_id AS source, event_type, CASE event_type WHEN 'error' THEN [('cpu_hardware', 4)] WHEN 'signup' THEN [('ram', 3)] WHEN 'purchase' THEN [('thermal', 2), ('thermal', 1)] ELSE [] END AS hits FROM events),
p AS (SELECT DISTINCT source, event_type, unnest(hits) AS h, generate_subscripts(hits, 1) AS i FROM l), g AS (SELECT source, h[1] AS cause, CAST(sum(h[2]) AS DOUBLE) AS score FROM p GROUP BY ALL)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, cause) AS INTEGER) AS rank, cause, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2.5 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def postmortem_verdict(spark, sf_dir):
    """Causes of crashes by what each source's last lines say of its hardware."""
    kind = F.col("event_type")
    said = F.when(kind == "error", "mce: [Hardware Error]: CPU ").when(kind == "signup", "EDAC MC0: 1 CE on ").when(kind == "purchase", "thermal event, clock throttled ").otherwise("all fine ")
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"), F.concat(said, F.get_json_object("props", "$.k")).alias("line"))
    return hardware.verdict(hardware.postmortem_points(lines, ["source"], "line"), ["source"]).select("source", "rank", "cause", "score", "confidence")


@query("""WITH t AS (SELECT conv_id, turn, role, text, substr(md5(CAST(conv_id // 3 AS VARCHAR)), 1, 12) AS trace FROM conversations), w AS (SELECT DISTINCT trace FROM t WHERE role = 'user' AND length(text) > 60)
SELECT t.trace AS trace_id, conv_id, turn, role, CAST(row_number() OVER (PARTITION BY t.trace ORDER BY conv_id, turn) AS INTEGER) AS step FROM t JOIN w ON t.trace = w.trace""")
def traced_turns(spark, sf_dir):
    """Turns as lines that name a trace, three conversations each: all lines of the traces in which a user wrote more than 60 characters, in order."""
    trace = F.substring(F.md5(F.floor(F.col("conv_id") / 3).cast("long").cast("string").cast("binary")), 1, 12)
    lines = table(spark, sf_dir, "conversations").withColumn("line", F.concat(F.lit("trace_id="), trace, F.lit(" "), F.get(F.split("text", "\n"), 0)))
    found = timeline.of_traces(lines.withColumn("trace_id", text.trace_id(F.col("line"))), (F.col("role") == "user") & (F.length("text") > 60), ["conv_id", "turn"])
    return found.select("trace_id", "conv_id", "turn", "role", "step")
