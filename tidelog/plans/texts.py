"""Queries over text functions and parsing: inputs are made of the shipped tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text, timeparse
from ..operators import errors, exceptions, parsing, roles, sequence, state, timeline
from ..sources import text as sources
from .catalogue import DAY, DOC_LINES, EV, T0, document_lines, events, query, table

def ident() -> Column:
    return F.col("event_id")


def choice(*values) -> Column:
    """The value at event_id modulo their number."""
    kind = {str: "string", int: "long", float: "double", bool: "boolean"}[_kind(values)]
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (ident() % len(values) + 1).cast("int"))


def choice_sql(*values) -> str:
    """The same in SQL."""
    kind = _kind(values)

    def shown(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" if kind is str else f"{v}::DOUBLE" if kind is float else str(v)

    return f"CAST(([{', '.join(map(shown, values))}])[event_id % {len(values)} + 1] AS { {str: 'VARCHAR', int: 'BIGINT', float: 'DOUBLE', bool: 'BOOLEAN'}[kind]})"


def _kind(values) -> type:
    return next((type(v) for v in values if v is not None), str)


_SHAPES = {"iso": 0, "iso_zone": -7_200_000, "slash": 0, "ctime": 0, "clf_zone": 18_000_000, "bsd": 0, "bsd_year": 0, "compact": 0, "us_date": 0, "us_short": 0, "logcat": 0}


@query(f"SELECT event_id, shape, CAST(epoch_us(ts) // 1000000 * 1000 + shift AS DOUBLE) AS ts_ms FROM events, (VALUES {', '.join(f'({k!r}, {v})' for k, v in _SHAPES.items())}) s(shape, shift)")
def stamp_shapes(spark, sf_dir):
    """Every event's time written in eleven shapes and read again."""
    at = lambda p: F.date_format(F.col("ts").cast("timestamp"), p)
    reads = {
        "iso": timeparse.iso_to_ms(at("yyyy-MM-dd HH:mm:ss")),
        "iso_zone": timeparse.parse_timestamp(F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))),
        "slash": timeparse.parse_timestamp(at("yyyy/MM/dd HH:mm:ss")),
        "ctime": timeparse.parse_timestamp(at("EEE MMM d HH:mm:ss yyyy")),
        "clf_zone": timeparse.parse_timestamp(F.concat(at("dd/MMM/yyyy:HH:mm:ss"), F.lit(" -0500"))),
        "bsd": timeparse.parse_timestamp(at("MMM d HH:mm:ss")),
        "bsd_year": timeparse.bsd_year_ms(at("MMM d yyyy HH:mm:ss")),
        "compact": timeparse.compact_ms(at("yyyyMMddHHmmss")),
        "us_date": timeparse.us_date_ms(at("M/d/yyyy"), at("h:mm:ss a")),
        "us_short": timeparse.us_date_ms(at("M/d/yy"), at("HH:mm:ss")),
        "logcat": timeparse.logcat_ms(at("MM-dd HH:mm:ss")),
    }
    shapes = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), v.alias("ts_ms")) for k, v in reads.items()]))
    return table(spark, sf_dir, "events").select("event_id", shapes.alias("s")).select("event_id", "s.shape", "s.ts_ms")


@query(f"WITH {EV} SELECT event_id, unit, CASE unit WHEN 'far' THEN NULL ELSE CAST(ts_ms AS DOUBLE) END AS ts_ms FROM ev, (VALUES ('s'), ('ms'), ('us'), ('ns'), ('far')) u(unit)")
def epoch_units(spark, sf_dir):
    """Epoch numbers in seconds to nanoseconds, and numbers of no sane time."""
    ms = F.col("ts_ms").cast("decimal(38,3)")
    shown = {"s": ms / 1000, "ms": ms, "us": ms * 1000, "ns": ms * 1_000_000, "far": ms * 50}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), v.cast("string").alias("v")) for k, v in shown.items()]))
    return events(spark, sf_dir).select("event_id", rows.alias("s")).select("event_id", "s.unit", F.round(timeparse.sane_ms(timeparse.coerce_timestamp(F.col("s.v")))).alias("ts_ms"))


@query(f"WITH {EV} SELECT event_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM ev")
def iso_stamps(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", timeparse.ms_to_iso(F.col("ts_ms")).alias("iso"))


_LEVEL_ROWS = ", ".join(f"('{w}', '{level}')" for level, ws in levels.LEVEL_WORDS.items() for w in ws.split())
_CATEGORY_ROWS = ", ".join(f"('{level}', '{levels.LEVEL_CATEGORY[level]}', {rank})" for level, rank in levels.LEVEL_RANK.items())


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents), l AS (SELECT word, coalesce(m.level, upper(word)) AS level FROM w LEFT JOIN (VALUES {_LEVEL_ROWS}) m(key, level) ON lower(word) = m.key)
SELECT word, l.level, coalesce(c.category, 'log') AS category, CAST(coalesce(c.rank, 0) AS BIGINT) AS rank FROM l LEFT JOIN (VALUES {_CATEGORY_ROWS}) c(level, category, rank) ON l.level = c.level""")
def level_words(spark, sf_dir):
    """Every distinct word of all documents as a level."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).distinct()
    level = levels.canonical_level(F.col("word"))
    return words.select("word", level.alias("level"), levels.level_category(level).alias("category"), levels.level_rank(level).cast("long").alias("rank"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' OR turn % 3 = 0 THEN md5(text) END AS trace_id FROM conversations")
def trace_ids(spark, sf_dir):
    """Every turn as a line that names its text's digest: users' as a request, every third of the others' as a trace, the rest as nothing that is known."""
    c, user = table(spark, sf_dir, "conversations"), F.col("role") == "user"
    first = F.get(F.split("text", "\n"), 0)
    line = F.concat(first, F.when(user, " request_id=").when(F.col("turn") % 3 == 0, ' traceId: "').otherwise(" digest of "), F.md5(F.col("text").cast("binary")), F.lit('" done'))
    return c.select("conv_id", "turn", text.trace_id(line).alias("trace_id"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN (CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 40 THEN 'index out of bounds' ELSE 'disk full' END) WHEN 'signup' THEN 'missing key' WHEN 'purchase' THEN 'connection refused'
WHEN 'click' THEN (CASE WHEN value > 30 THEN 'timeout' END) ELSE 'misused channel' END AS cause FROM events""")
def probable_causes(spark, sf_dir):
    """Failures as the events' types and fields would raise them; a click below 30 raises nothing that is known."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    raised = F.when((kind == "error") & (k.cast("long") >= 40), "OSError").when(kind == "signup", "KeyError").when(kind == "purchase", "Error").when((kind == "click") & (F.col("value") > 30), "java.net.SocketTimeoutException").when(kind.isin("error", "view"), "panic").otherwise("Custom")
    message = F.when((kind == "error") & (k.cast("long") < 40), F.concat(F.lit("runtime error: index out of range ["), k, F.lit("]"))).when(kind == "error", F.concat(F.lit("[Errno 28] No space left on device "), k)).when(kind == "signup", k).when(kind == "purchase", F.concat(F.lit("connect ECONNREFUSED 10.0.0."), k)).when(kind == "click", "seen").otherwise(F.concat(F.lit("send on closed channel "), k))
    return table(spark, sf_dir, "events").select("event_id", text.probable_cause(raised, message).alias("cause"))


#: Blocks of nine languages, C++ with two numbered frames: (language, text with # for a number, type, message, frames, first file).
_BLOCKS = [
    ("python", "Traceback (most recent call last):\n  File \"a.py\", line #, in f\n    g()\n  File \"b.py\", line 9, in g\n    x[1]\nKeyError: k#", "KeyError", "k#", 2, "a.py"),
    ("java", "Exception in thread \"main\" java.lang.RuntimeException: outer\n\tat a.B.c(B.java:10)\nCaused by: java.lang.IllegalStateException: inner #\n\tat a.B.d(D.java:20)", "IllegalStateException", "inner #", 2, "B.java"),
    ("go", "panic: failed # times\n\ngoroutine 1 [running]:\nmain.main()\n\t/x/main.go:12 +0x1", "panic", "failed # times", 1, "/x/main.go"),
    ("node", "TypeError: x# is not a function\n    at foo (/a/b.js:3:5)\n    at bar (/a/c.js:4:1)", "TypeError", "x# is not a function", 2, "/a/b.js"),
    ("rust", "thread 'main' panicked at src/main.rs:2:5:\nboom #", "panic", "boom #", 1, "src/main.rs"),
    ("rust", "thread 'main' panicked at 'boom #', src/lib.rs:7:5\nstack backtrace:\n   0: app::run\n             at ./src/lib.rs:7\n   1: app::main\n             at ./src/main.rs:3", "panic", "boom #", 3, "src/lib.rs"),
    ("ruby", "app.rb:3:in `foo': no # here (NoMethodError)\n\tfrom app.rb:9:in `<main>'", "NoMethodError", "no # here", 2, "app.rb"),
    ("dotnet", "Unhandled exception. System.InvalidOperationException: seq #\n   at A.B.C(String x) in /x/y.cs:line 4", "InvalidOperationException", "seq #", 1, "/x/y.cs"),
    ("cpp", "terminate called after throwing an instance of 'std::out_of_range'\n  what():  bad index #\n#1  0x00 in at(int) at /a/v.cpp:3\n#2  main () at /a/m.cpp:9", "std::out_of_range", "bad index #", 2, "/a/v.cpp"),
    ("php", "PHP Fatal error:  Uncaught Exception: bad # in /a/x.php:3\nStack trace:\n#0 /a/y.php(4): foo()", "Exception", "bad #", 1, "/a/y.php"),
]


def _user_choice(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("user_id") % len(values) + 1).cast("int"))


_USER_SQL = lambda i: choice_sql(*[b[i] for b in _BLOCKS]).replace("event_id", "user_id")


@query(f"SELECT event_id, {_USER_SQL(0)} AS language, {_USER_SQL(2)} AS type, replace({_USER_SQL(3)}, '#', json_extract_string(props, '$.k')) AS message, {_USER_SQL(4)} AS n_frames, {_USER_SQL(5)} AS file FROM events")
def tracebacks(spark, sf_dir):
    """Each user's program is in one of nine languages and fails with what the event holds."""
    # the marks of frames stay
    block = F.regexp_replace(_user_choice([b[1] for b in _BLOCKS], "string"), F.lit("#(?!\\d )(?!\\d  )"), F.get_json_object("props", "$.k"))
    found = exceptions.parse_exceptions(table(spark, sf_dir, "events").select("event_id", block.alias("block")), "block")
    return found.select("event_id", "language", "type", "message", F.size("frames").cast("long").alias("n_frames"), F.get("frames", F.lit(0))["file"].alias("file"))


_STACK_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{cause}'" for cause, words in text.STACK_CAUSES.items()) + " END"


@query(f"WITH b AS (SELECT 'd' || doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 'p' || page_id, lower(html) FROM pages) SELECT id, {_STACK_SQL} AS cause FROM b")
def stack_causes(spark, sf_dir):
    """What documents and pages are about by the words of stacks."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return d.unionByName(p).select("id", text.stack_cause(F.col("text")).alias("cause"))


_ERROR_SQL = lambda t: "(" + " OR ".join(f"contains(lower(regexp_replace({t}, '\\s+', '', 'g')), '{k}')" for k in text.ERROR_KEYWORDS) + ")"
_SCREENS = """s AS (SELECT 'd' || doc_id AS id, text, lang IS NOT NULL AS ok FROM documents UNION ALL SELECT 'p' || page_id, html, true FROM pages UNION ALL SELECT 'e' || event_id, CASE WHEN value > 20 THEN event_type || ' ' || props || chr(10) || event_type ELSE ' ' END, user_id % 7 <> 0 FROM events)"""


@query(f"""WITH {_SCREENS}, l AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM s WHERE ok) WHERE {_ERROR_SQL('line')} GROUP BY 1)
SELECT s.id, CASE WHEN NOT ok OR trim(text) = '' THEN 'unreadable' WHEN {_ERROR_SQL('text')} THEN 'found' ELSE 'none' END AS verdict, least(coalesce(n, 0), 5) AS n_lines FROM s LEFT JOIN l ON s.id = l.id""")
def screen_verdicts(spark, sf_dir):
    """Documents, pages and events as what a screen shows: error words may be torn apart by white space."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    d = table(spark, sf_dir, "documents").select(name("d", "doc_id"), "text", F.col("lang").isNotNull().alias("ok"))
    p = table(spark, sf_dir, "pages").select(name("p", "page_id"), F.col("html").alias("text"), F.lit(True).alias("ok"))
    shown = F.when(F.col("value") > 20, F.concat("event_type", F.lit(" "), "props", F.lit("\n"), "event_type")).otherwise(" ")
    e = table(spark, sf_dir, "events").select(name("e", "event_id"), shown.alias("text"), (F.col("user_id") % 7 != 0).alias("ok"))
    s, t = d.unionByName(p).unionByName(e), F.col("text")
    return s.select("id", text.screen_verdict(t, F.col("ok")).alias("verdict"), F.size(F.when(F.col("ok"), text.error_lines(t)).otherwise(F.array().cast("array<string>"))).cast("long").alias("n_lines"))


_FAILS_SQL = " OR ".join(f"starts_with(w, '{k}')" for k in text.FAILURE_KINDS)


@query(f"""WITH k AS (SELECT DISTINCT event_type || '.' || p_name AS kind FROM events, part UNION SELECT DISTINCT unnest(string_split(text, ' ')) FROM documents), w AS (SELECT kind, unnest(regexp_split_to_array(lower(kind), '[^a-z0-9]+')) AS w FROM k)
SELECT kind, bool_or({_FAILS_SQL}) AS failed FROM w GROUP BY 1""")
def failure_kinds(spark, sf_dir):
    """Every word of the documents, and every pair of an event's type and a part's name, as the kind of a record."""
    types, names = table(spark, sf_dir, "events").select("event_type").distinct(), table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = types.groupBy().agg(F.collect_set("event_type").alias("t")).select(F.explode("t").alias("event_type")).join(F.broadcast(names.groupBy().agg(F.collect_set("p_name").alias("n"))), F.lit(True)).select(F.explode(F.transform("n", lambda n: F.concat("event_type", F.lit("."), n))).alias("kind"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("kind"))
    return pairs.union(words).distinct().select("kind", text.is_failure_kind(F.col("kind")).alias("failed"))


@query(r"""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, chr(10), '\n') || '\n ' || role END AS t FROM conversations),
l AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(t, '\r?\n|\\n'), lambda x: trim(x) <> '') AS l FROM b) SELECT conv_id, turn, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM l""")
def logical_lines(spark, sf_dir):
    """Turns of conversations, every second with its line ends spelt out."""
    block = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\\n "), "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.logical_lines(block)).alias("i", "line")).select("conv_id", "turn", F.col("i").cast("long").alias("i"), "line")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN n_chars WHEN 'de' THEN n_chars * 1024 WHEN 'fr' THEN n_chars * 1048576 WHEN 'es' THEN CAST(n_chars / 8.0::DOUBLE * 1073741824 AS BIGINT) ELSE 7 END AS bytes FROM documents")
def byte_sizes(spark, sf_dir):
    """Documents' lengths as a configuration would spell them, in the unit of their language."""
    n = F.col("n_chars").cast("string")
    shown = F.when(F.col("lang") == "en", n).when(F.col("lang") == "de", F.concat(n, F.lit(" KiB"))).when(F.col("lang") == "fr", F.concat(n, F.lit("MB"))).when(F.col("lang") == "es", F.concat((F.col("n_chars") / 8.0).cast("decimal(20,3)").cast("string"), F.lit(" gb"))).otherwise(F.concat(n, F.lit(" parsecs")))
    return table(spark, sf_dir, "documents").select("doc_id", text.parse_bytes(shown, 7).alias("bytes"))


@query("""WITH s AS (SELECT doc_id, n_chars % 4000 + 1 AS w, strlen(text) % 3000 + 1 AS h FROM documents), c AS (SELECT *, CASE WHEN greatest(w, h) > 2576 THEN 2576::DOUBLE / greatest(w, h) ELSE 1::DOUBLE END AS k FROM s)
SELECT doc_id, least(CAST(ceil(greatest(floor(w * k), 1) / 28) * ceil(greatest(floor(h * k), 1) / 28) AS BIGINT), 4784) AS tokens FROM c""")
def image_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.visual_tokens(F.col("n_chars") % 4000 + 1, F.octet_length("text") % 3000 + 1).alias("tokens"))


@query("SELECT event_id, unnest(['level', 'msg', 'k']) AS key, unnest(['warn', 'slow ' || event_id, CAST(user_id AS VARCHAR)]) AS value FROM events")
def logfmt_fields(spark, sf_dir):
    from ..functions import formats

    line = F.concat(F.lit('level=info k=1 msg="slow '), ident().cast("string"), F.lit('" level=warn k='), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(formats.pairs(line)).alias("key", "value"))


@query("SELECT event_id, unnest(['host', 'user', 'k', 'kind']) AS key, unnest(['user_' || user_id, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k'), event_type]) AS value FROM events")
def enriched_fields(spark, sf_dir):
    """What is known stays, the event's JSON comes before pairs, the first of a repeated key counts."""
    u = F.col("user_id").cast("string")
    message = F.concat(F.lit("user="), u, F.lit(" kind="), "event_type", F.lit(" host=no k=none "), "props", F.lit(" kind=second"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(text.enriched(message, F.create_map(F.lit("host"), F.concat(F.lit("user_"), u)))).alias("key", "value"))


@query("""WITH m AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k') AS k, value > 30 AS dear, lag(event_type) OVER w AS pt, lag(json_extract_string(props, '$.k')) OVER w AS pk, lag(value > 30) OVER w AS pd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN dear AND (pd IS NULL OR NOT pd) THEN 1 ELSE 0 END + CASE WHEN pt IS NULL THEN 2 ELSE 0 END AS n_added, CASE WHEN pd AND NOT dear THEN 1 ELSE 0 END AS n_removed, CASE WHEN pt <> t THEN 1 ELSE 0 END + CASE WHEN pk <> k THEN 1 ELSE 0 END AS n_changed FROM m""")
def map_deltas(spark, sf_dir):
    """Each event's state against the one before of its user: type and k, and a price's mark only where it is dear."""
    base = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("m", F.when(F.col("value") > 30, F.map_concat(base, F.create_map(F.lit("dear"), F.lit("yes")))).otherwise(base))
    rows = sequence.with_previous(e.select("event_id", "user_id", "us", "m"), ["user_id"], ["us", "event_id"], ["m"], DAY * 1000.0)
    d = state.map_delta(F.coalesce(F.col("_p.m"), F.create_map().cast("map<string,string>")), F.col("m"))
    return rows.select("event_id", d.alias("d")).select("event_id", *[F.col(f"d.{c}").cast("long").alias(c) for c in ("n_added", "n_removed", "n_changed")])


def rendered(spark, sf_dir) -> DataFrame:
    """Events as lines, each user's in one of five formats."""
    at = lambda p: F.date_format(F.col("ts").cast("timestamp"), p)
    n = ident().cast("string")
    kinds = [
        F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" [main] WARN app.Svc - event "), n),
        F.concat(F.lit('{"ts": "'), at("yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z", "level": 50, "msg": "event '), n, F.lit('", "logger": "app.Svc"}')),
        F.concat(F.lit("["), at("yyyy-MM-dd HH:mm:ss"), F.lit("] [app.Svc] [info] event "), n),
        F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" | ERROR    | app:Svc:12 - event "), n),
        F.concat(F.lit("level=warn ts="), at("yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z msg="event '), n, F.lit('" k=1')),
    ]
    line = F.element_at(F.array(*kinds), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("src"), line.alias("line"))


@query("""SELECT event_id, CAST(epoch_us(ts) // 1000000 * 1000 AS DOUBLE) AS ts_ms, (['WARN', 'ERROR', 'INFO', 'ERROR', 'WARN'])[user_id % 5 + 1] AS level, 'event ' || event_id AS message,
(['log4j', 'jsonl', 'spdlog', 'loguru', 'structural'])[user_id % 5 + 1] AS adapter FROM events""")
def parsed_lines(spark, sf_dir):
    """Each source's format is detected and its lines read by it."""
    found = parsing.normalised(rendered(spark, sf_dir), "src", "line", ["event_id"])
    return found.select("event_id", "ts_ms", "level", "message", "adapter")


@query("""SELECT 'user_' || user_id AS src, count(*) AS n, CASE WHEN user_id % 5 = 4 THEN count(*) ELSE 0 END AS gaps, user_id % 5 <> 4 AS ready FROM events GROUP BY user_id""")
def source_coverage(spark, sf_dir):
    return parsing.coverage(parsing.recognised(rendered(spark, sf_dir), "src", "line", ["event_id"]), "src")


@query("""WITH d AS (SELECT DISTINCT 'user_' || c_custkey AS src FROM customer), f AS (SELECT 'user_' || user_id AS src, user_id % 5 AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT coalesce(d.src, f.src) AS src, coalesce(n, 0) AS n, CASE WHEN k = 4 THEN n ELSE 0 END AS gaps, coalesce(k <> 4, false) AS ready, CASE WHEN n IS NULL THEN 'pending' WHEN k <> 4 THEN 'covered' ELSE 'gaps' END AS verdict FROM d FULL JOIN f ON d.src = f.src""")
def coverage_verdicts(spark, sf_dir):
    """Every customer has declared a source; those that have logged nothing are pending."""
    declared = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("src"))
    return parsing.coverage(parsing.recognised(rendered(spark, sf_dir), "src", "line", ["event_id"]), "src", declared)


@query("""SELECT event_id, epoch_us(ts) // 1000 + 0.0::DOUBLE AS ts_ms, event_type AS category, CASE WHEN user_id % 2 = 0 THEN (CASE event_type WHEN 'error' THEN 'FATAL' ELSE 'DEBUG' END) WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
'user_' || user_id AS source, 'said ' || json_extract_string(props, '$.k') AS message, json_extract_string(props, '$.k') AS k FROM events""")
def native_records(spark, sf_dir):
    """Events written as this engine's own JSON records keep their category and data; every second one names its level in data."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    level = F.when(F.col("user_id") % 2 == 0, F.when(F.col("event_type") == "error", "fatal").otherwise("debug"))
    data = F.struct(F.concat(F.lit("said "), k).alias("message"), level.alias("level"), k.alias("k"))
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    line = F.to_json(F.struct(ts.alias("ts_ms"), F.col("event_type").alias("category"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"), data.alias("data")))
    found = parsing.normalised(e.select("event_id", F.lit("own").alias("src"), line.alias("line")), "src", "line", ["event_id"])
    return found.select("event_id", "ts_ms", "category", "level", F.col("event_source").alias("source"), "message", F.try_element_at("data", F.lit("k")).alias("k"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 * 1000 AS DOUBLE) AS ts_ms, CASE WHEN event_id % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'log' END AS category, 'event ' || event_id AS message FROM events")
def container_lines(spark, sf_dir):
    """Container runtimes' JSON lines: stderr is of category error."""
    line = F.concat(F.lit('{"log":"event '), ident().cast("string"), F.lit('\\n","stream":"'), choice("stderr", "stdout"), F.lit('","time":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('.000000000Z"}'))
    return parsing.docker_json(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line").select("event_id", "ts_ms", "level", "category", "message")


@query(f"WITH {EV} SELECT event_id, ts_ms FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + 5 * DAY} AND category = 'error' AND contains(source, '_1')")
def range_of_source(spark, sf_dir):
    return timeline.range_query(events(spark, sf_dir), T0, T0 + 5 * DAY, "error", "_1").select("event_id", "ts_ms")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE level IN ('WARN', 'ERROR', 'FATAL') AND contains(lower(props), '\"k\": 5') AND category = 'error'")
def search_errors(spark, sf_dir):
    return timeline.search(events(spark, sf_dir), "props", '"K": 5', level="WARN", category="error").select("event_id")


@query("SELECT page_id, url FROM pages WHERE contains(lower(html), 'track(')")
def search_bad_regex(spark, sf_dir):
    """A query that is no regular expression is looked for as it stands."""
    return timeline.search(table(spark, sf_dir, "pages"), "html", "Track(", regex=True).select("page_id", "url")


@query(f"WITH {EV} SELECT event_id, ts_ms FROM ev ORDER BY ts_ms, event_id LIMIT 50 OFFSET 100")
def timeline_page(spark, sf_dir):
    return timeline.page(events(spark, sf_dir), ["ts_ms", "event_id"], 50, 100).select("event_id", "ts_ms")


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no FROM dl WHERE NOT contains(line, 'tion') AND NOT contains(line, 'GNU General')")
def without_own_lines(spark, sf_dir):
    """Document lines that hold neither mark."""
    return timeline.without_own(document_lines(spark, sf_dir), ["tion", "GNU General"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {EV} SELECT event_id FROM ev WHERE source = 'user_9'")
def labelled_rows(spark, sf_dir):
    return timeline.labelled(events(spark, sf_dir).withColumn("log_label", F.col("source")), "user_9").select("event_id")


_NORMAL = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '0x[0-9a-fA-F]+', '0xHEX', 'g'), '[A-Za-z]:[\\\\/][^\\s:''\",)\\]]+', '/PATH', 'g'), '/[^\\s:]+', '/PATH', 'g'), '[0-9]+', 'N', 'g'), '\\s+', ' ', 'g'))"
_SAID = "This work is licensed under the GNU General Public License, version 77."


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no FROM dl WHERE sha1({_NORMAL('line')}) = sha1({_NORMAL(repr(_SAID))})")
def errors_of_fingerprint(spark, sf_dir):
    """Document lines of the fingerprint of a known one."""
    return errors.of_fingerprint(document_lines(spark, sf_dir), "line", text.fingerprint(F.lit(_SAID))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("""WITH t AS (SELECT event_type, 'a=' || (CAST(json_extract(props, '$.k') AS BIGINT) * 1000 + user_id) AS token FROM events)
SELECT token, token IN (SELECT token FROM t WHERE event_type = 'error') AS corroborated FROM (SELECT DISTINCT token FROM t WHERE event_type = 'view' AND len(token) >= 4)""")
def corroborate_claims(spark, sf_dir):
    """Pairs that views show and whether an error's line has them too."""
    e, pair = table(spark, sf_dir, "events"), (F.get_json_object("props", "$.k").cast("long") * 1000 + F.col("user_id")).cast("string")
    of = lambda rows, c: rows.select(F.explode(F.filter(roles.tokens(c), lambda t: t.startswith("a="))).alias("token")).distinct()
    shown = of(e.filter("event_type = 'view'"), F.concat(F.lit("state a="), pair))
    logged = of(e.filter("event_type = 'error'"), F.concat(F.lit("log has a="), pair, F.lit(", done")))
    return roles.corroborated(shown, "token", logged, "token")


@query("SELECT p_partkey, unnest(['fan_rpm', 'cpu_load', 'size']) AS key, unnest([CAST(p_size * 100 AS VARCHAR) || ' rpm', CAST(p_size AS VARCHAR) || '%', CAST(p_size AS VARCHAR)]) AS value FROM part")
def report_values(spark, sf_dir):
    """Key: value lines of boxed reports; the last of a repeated key is kept."""
    n = F.col("p_size").cast("string")
    report = F.concat(F.lit("+------+\n| Fan  RPM : 0 |\n| Fan RPM: "), (F.col("p_size") * 100).cast("string"), F.lit(" rpm |\n| CPU Load: "), n, F.lit("% |\n  Size: "), n, F.lit("\n+------+"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(sources.key_values(report)).alias("key", "value"))


@query("SELECT p_partkey, unnest(['name', 'size']) AS key, unnest(['p' || p_partkey, CAST(p_size AS VARCHAR)]) AS value FROM part")
def ini_values(spark, sf_dir):
    ini = F.concat(F.lit("[part]\n name = p"), F.col("p_partkey").cast("string"), F.lit("\n; note\nsize="), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(sources.ini_fields(ini)).alias("f")).select("p_partkey", "f.key", "f.value")


@query("SELECT p_partkey AS gpu, 'card ' || p_size AS name, CAST(p_size AS DOUBLE) AS temp, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 40.0::DOUBLE END AS load, CAST(p_size * 2 AS DOUBLE) AS watts FROM part")
def gpu_samples(spark, sf_dir):
    n = F.col("p_size").cast("string")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(", card "), n, F.lit(", "), n, F.lit(", "), F.when(F.col("p_partkey") % 3 == 0, "[N/A]").otherwise("40 %"), F.lit(", "), (F.col("p_size") * 2).cast("string"), F.lit(" W"))
    return sources.gpu_csv(table(spark, sf_dir, "part").select(line.alias("line")), "line").select(F.col("gpu").cast("long").alias("gpu"), "name", "temp", "load", "watts")


@query("SELECT n_name AS machine, arg_max('card ' || s_suppkey, (round(s_acctbal), -s_suppkey)) AS name, CAST(max(round(s_acctbal)) AS DOUBLE) AS temp FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def hottest_cards(spark, sf_dir):
    """A machine for each nation, a card for each of its suppliers: the hottest card of each."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("s_suppkey").cast("string")
    line = F.concat(n, F.lit(", card "), n, F.lit(", "), F.round("s_acctbal").cast("long").cast("string"), F.lit(", [N/A], 80 W"))
    return sources.hottest_card(sources.gpu_csv(s.select(F.col("n_name").alias("machine"), line.alias("line")), "line", ["machine"]), ["machine"]).select("machine", "name", "temp")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS r FROM supplier)
SELECT n_name AS machine, CAST(s_suppkey AS VARCHAR) AS fps, s_suppkey * 2 || ' ms' AS frame_ms FROM s JOIN nation ON s_nationkey = n_nationkey WHERE r = 1""")
def latest_stats(spark, sf_dir):
    """Each machine's newest stats file, its keys by the names that the engine knows."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("s_suppkey")
    report = F.concat(F.lit("+----+\n| Frames Per Second: "), n.cast("string"), F.lit(" |\n| Frame Time: "), (n * 2).cast("string"), F.lit(" ms |"))
    files = s.select(F.col("n_name").alias("machine"), F.concat(F.lit("/log/stats_"), n.cast("string"), F.lit(".log")).alias("path"), F.struct("s_acctbal", "s_suppkey").alias("modified"), report.alias("text"))
    found = sources.latest_report(files, ["machine"], {"frames_per_second": "fps", "frame_time": "frame_ms"})
    return found.select("machine", F.col("values.fps").alias("fps"), F.col("values.frame_ms").alias("frame_ms"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS speed, 4.0::DOUBLE AS cpus FROM part")
def thermal_limits(spark, sf_dir):
    report = F.concat(F.lit("Note: thermal\nCPU_Scheduler_Limit = 100\nCPU_Available_CPUs = 4\nCPU_Speed_Limit = "), F.col("p_size").cast("string"))
    m = sources.thermal_report(report)
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(m, F.lit("CPU_Speed_Limit")).alias("speed"), F.try_element_at(m, F.lit("CPU_Available_CPUs")).alias("cpus"))


@query("""SELECT 'hwmon' || p_partkey || '/' || (['temp', 'fan', 'in', 'power'])[p_partkey % 4 + 1] || '1' AS sensor, (['temp', 'fan', 'volt', 'power'])[p_partkey % 4 + 1] AS kind,
p_size * 1000 / ([1000.0::DOUBLE, 1.0::DOUBLE, 1000.0::DOUBLE, 1000000.0::DOUBLE])[p_partkey % 4 + 1] AS value FROM part""")
def hwmon_values(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("temp", "fan", "in", "power")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/sys/class/hwmon/hwmon"), F.col("p_partkey").cast("string"), F.lit("/"), kind, F.lit("1_input"))
    return sources.hwmon(table(spark, sf_dir, "part").select(path.alias("path"), (F.col("p_size") * 1000).cast("string").alias("value")), "path", "value")


@query("SELECT CAST(c_custkey + 100 AS INTEGER) AS pid, '/var/log/' || c_mktsegment || ' ' || c_name || '.log' AS path FROM customer WHERE c_acctbal >= 0")
def open_for_writing(spark, sf_dir):
    """Customers with a balance as programs that write their log, the others read it."""
    mode = F.when(F.col("c_acctbal") >= 5000, "3w").when(F.col("c_acctbal") >= 0, "4u").otherwise("5r")
    line = F.concat(F.lit("app  "), (F.col("c_custkey") + 100).cast("string"), F.lit(" root "), mode, F.lit(" REG 8,1 512 77 /var/log/"), "c_mktsegment", F.lit(" "), "c_name", F.lit(".log"))
    return sources.write_targets(table(spark, sf_dir, "customer").select(line.alias("line")), "line")


@query("SELECT p_partkey, p_size AS passed, p_partkey % 3 AS failed FROM part")
def test_totals(spark, sf_dir):
    out = F.concat(F.lit("== "), (F.col("p_partkey") % 3).cast("string"), F.lit(" failed, "), F.col("p_size").cast("string"), F.lit(" passed in 3s =="))
    s = sources.test_summary(out)
    return table(spark, sf_dir, "part").select("p_partkey", s["passed"].cast("long").alias("passed"), s["failed"].cast("long").alias("failed")).select("p_partkey", F.col("passed").cast(table(spark, sf_dir, "part").schema["p_size"].dataType).alias("passed"), F.col("failed").cast(table(spark, sf_dir, "part").schema["p_partkey"].dataType).alias("failed"))


def code(spark, sf_dir, path=None) -> DataFrame:
    """A small source file for each part, made of its name, type and size."""
    n, name = F.col("p_partkey").cast("string"), F.split("p_name", " ")
    body = F.concat(F.lit("import "), F.get(name, 0), F.lit("\nfrom app.mod"), F.col("p_size").cast("string"), F.lit(" import x\n\nclass "), F.initcap(F.get(name, 1)), n, F.lit(":\n    def run_"), F.lower("p_type"), F.lit("(self):\n        raise ValueError('"), "p_name", F.lit("')\n"))
    return table(spark, sf_dir, "part").select((F.concat(F.lit("/src/f"), n, F.lit(".py")) if path is None else path).alias("path"), body.alias("text"))


@query("SELECT '/src/f' || p_partkey || '.py' AS path, unnest([split_part(p_name, ' ', 1), 'app.mod' || p_size]) AS module FROM part")
def imported_modules(spark, sf_dir):
    return sources.import_edges(code(spark, sf_dir), "path", "text")


@query("SELECT '/src/f' || p_partkey || '.py' AS path, unnest(['class', 'def']) AS kind, unnest([upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || p_partkey, 'run_' || lower(p_type)]) AS name FROM part")
def code_symbols(spark, sf_dir):
    return sources.symbols(code(spark, sf_dir), "path", "text")


@query("SELECT '/src/f' || p_partkey || '.py' AS path, '/src/f' || p_partkey || '.py: class ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || p_partkey || ', def run_' || lower(p_type) AS line FROM part")
def source_outline(spark, sf_dir):
    return sources.light_digest(code(spark, sf_dir), "path", "text")


@query("""WITH c AS (SELECT '/src/' || replace(p_brand, '#', '') || '/f' || p_partkey || '.py' AS path, p_partkey, unnest(range(1, 7)) AS line_no, unnest(['import ' || split_part(p_name, ' ', 1), 'from app.mod' || p_size || ' import x', '', 'class ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || p_partkey || ':', '    def run_' || lower(p_type) || '(self):', '        raise ValueError(' || chr(39) || p_name || chr(39) || ')']) AS text FROM part),
f AS (SELECT event_id, user_id * 3 % (SELECT count(*) FROM part) AS part, CAST(json_extract(props, '$.k') AS INTEGER) % 12 AS line FROM events WHERE event_type = 'error')
SELECT event_id, line_no, text FROM f JOIN c ON f.part = c.p_partkey AND c.line_no BETWEEN line - 1 AND line + 1""")
def frames_in_code(spark, sf_dir):
    """Frames of error events, which name a part's file from its brand's folder on, joined with the code around them."""
    part = table(spark, sf_dir, "part")
    folder = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    files = code(spark, sf_dir, F.concat(F.lit("/src/"), folder)).select("path", F.posexplode(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")
    named = part.select("p_partkey", folder.alias("file"))
    errors_ = table(spark, sf_dir, "events").filter("event_type = 'error'").join(part.agg(F.count("*").alias("n")), F.lit(True)).select("event_id", (F.col("user_id") * 3 % F.col("n")).alias("p_partkey"), (F.get_json_object("props", "$.k").cast("int") % 12).alias("line"))
    return exceptions.source_lines(errors_.join(named.hint("merge"), "p_partkey"), files, 1).select("event_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query("""SELECT '/log/' || c_custkey AS path, CASE WHEN c_mktsegment = 'BUILDING' THEN 'silent' WHEN c_acctbal < 0 THEN 'unlisted' WHEN abs(c_acctbal) / 10 > 120 THEN 'stale' ELSE 'ok' END AS verdict,
CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE abs(c_acctbal) / 10 END AS age_s FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal >= 0""")
def reconciled_logs(spark, sf_dir):
    """Logs of customers: those in debt are not configured, builders have written none, others as long ago as their balance says."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("/log/"), F.col("c_custkey").cast("string")).alias("path"), "c_mktsegment", "c_acctbal")
    return state.reconcile(c.filter("c_acctbal >= 0"), c.filter("c_mktsegment <> 'BUILDING'").select("path", (F.abs("c_acctbal") / 10).alias("age_s")))
