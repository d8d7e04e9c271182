"""Fingerprints, fields and other things to read from a line, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that name no role of an address.
NON_ROLE_KEYS = "size bytes len length count n idx index ms us ns s sec secs seconds pct percent width height w h line lineno pid tid port".split()
# A key starts with a letter, goes on for 40 more at most, and nothing like a word stands before it; its value ends at white space or a closing mark.
KEY_VALUE = r"(?<![\p{Alnum}_.])(\p{Alpha}[-\p{Alnum}_#.]{0,40})\s*[:=]\s*([^,;)}\s\]]+)"
# With the prefix 4 to 16 digits, without it 6 to 16.
HEX_TOKEN = r"\b(0[xX]\p{XDigit}{4,16}|\p{XDigit}{6,16})\b"
NUMBER = r"(?<![.\w])([-]?[0-9]+(?:[.][0-9]+)?)(?![.\w])"
_TRACE_KEYS = ["trace.?id", "traceparent", "request.?id", "correlation.?id"]
TRACE_ID = r"(?i)\b(?:" + "|".join(k.replace(".?", "[-_]?") for k in _TRACE_KEYS) + r")[\s:=\"]+([-A-Za-z0-9]{6,})"
# Error words that a screen's text is searched for.
ERROR_KEYWORDS = "error exception traceback failed failure fatal crash panic segfault assert unhandled abort".split()
FAILURE_KINDS = "error fail exception crash fatal panic assert abort timeout".split()
#: Causes in the order in which they are tried: cause | exception types, without their namespace and the endings Error and Exception | codes and numbers that stand as words | phrases.
CAUSES = """
missing key | key keynotfound nosuchelement | | key not found; no such key
index out of bounds | index indexoutofbounds arrayindexoutofbounds stringindexoutofbounds indexoutofrange outofrange out_of_range | | index out of range; index out of bounds; list index; array index
null dereference | nullpointer nullreference argumentnull uninitializedproperty | | nonetype; nil pointer; nil map; null pointer; undefined is not; properties of undefined; properties of null; property of undefined; property of null; is null; on null
unwrap of nothing | bad_optional_access | | ::unwrap(); ::expect(); called `option; called `result; unwrap on a `none; none value
unbounded recursion | stackoverflow recursion internal | | maximum call stack; maximum recursion; too much recursion; stack overflow; stack level too deep
missing method or attribute | attribute nomethod methodnotfound missingmethod nosuchmethod nosuchfield badmethodcall | | has no attribute; undefined method; is not a function; call to undefined method
undefined name | name reference unboundlocal undefinedvariable | | is not defined; undeclared identifier; undefined variable; cannot find symbol; undefined: 
malformed address | uri urisyntax malformedurl uriformat invalidurl | | uri malformed; malformed url; invalid url; unsupported protocol scheme
misused eval | eval | |
unreadable text | unicodedecode unicodeencode unicodetranslate unicode charactercoding encoding decoderfallback encoderfallback invalidbytesequence | | can't decode; can't encode; invalid byte sequence; malformed utf; invalid utf-8
interrupted | keyboardinterrupt interrupted interrupt | sigint | interrupted by user
cancelled | cancelled canceled operationcanceled taskcanceled cancellation abort | | context canceled; operation was canceled; operation was cancelled; was aborted
not implemented | notimplemented unsupportedoperation notsupported | | not implemented; not yet implemented; unimplemented
frozen object | frozen frozeninstance readonly immutable | | can't modify frozen; read only property; object is not extensible
numeric overflow | overflow arithmeticoverflow | | integer overflow; attempt to add with overflow; attempt to multiply with overflow; attempt to subtract with overflow; result too large
modified while iterated | concurrentmodification | | changed size during iteration; collection was modified; mutated during iteration
invalid cast | classcast invalidcast bad_cast bad_any_cast | | cannot be cast; incompatible types; interface conversion
invalid state | illegalstate invalidoperation invalidstate objectdisposed illegalmonitorstate logic | |
invalid argument | illegalargument argument argumentoutofrange invalid_argument argumentcount | einval | wrong number of arguments; invalid argument; unexpected keyword argument; missing 1 required; required positional argument
value out of range | range domain length | erange | out of range; invalid array length
missing module | modulenotfound import classnotfound noclassdeffound load dllnotfound | module_not_found | no module named; cannot find module; unresolved import; cannot load such file; cannot find package
missing file | filenotfound nosuchfile directorynotfound | enoent | no such file; file not found; cannot find the path; cannot find the file
name lookup | unknownhost gaierror socketgai hostnotfound | enotfound eai_again | getaddrinfo; name or service not known; no such host; could not resolve host; name resolution
connection refused | connectionrefused | econnrefused | connection refused; actively refused
connection reset | connectionreset brokenpipe connectionaborted eof | econnreset epipe econnaborted | broken pipe; connection reset; socket hang up; closed by the remote
timeout | timeout sockettimeout connecttimeout readtimeout timeoutexpired | etimedout 504 | timed out; timeout; deadline exceeded
permission | permission accessdenied accesscontrol security unauthorizedaccess unauthorized forbidden | eacces eperm 401 403 | permission denied; access denied; access is denied; unauthorized; unauthorised; forbidden; not permitted
division by zero | zerodivision dividebyzero divisionbyzero | | division by zero; divide by zero; divided by 0; / by zero
assertion | assertion | sigabrt | assertion failed; assertion `; assert failed
out of memory | outofmemory memory nomemory bad_alloc | oom enomem oomkilled | out of memory; cannot allocate memory; heap space; memory exhausted; memory size
invalid memory access | segfault accessviolation | sigsegv sigbus | segmentation fault; access violation; invalid memory address; bus error
wrong type | type arraystore | | type mismatch; not assignable; cannot convert; unsupported operand; expected type
unparsable value | value syntax parse numberformat format jsondecode jsonparse jsonsyntax json unmarshaltype dateparse invalidformat | | invalid literal; invalid syntax; unexpected token; unexpected end of json; unmarshal; deserializ; could not parse; cannot parse; parse error
address in use | addressinuse bind | eaddrinuse | address already in use
disk full | disk diskfull | enospc edquot | no space left; disk full; disk is full; quota exceeded
too many open files | | emfile enfile | too many open files
rate limited | ratelimit toomanyrequests throttling | 429 | rate limit; too many requests; throttl
certificate | ssl sslhandshake certificate certificatevalidation x509 | | certificate; tls handshake; ssl; x509
pool exhausted | pooltimeout | | pool exhausted; pool is exhausted; no available connections; too many connections; queuepool limit
schema mismatch | undefinedtable undefinedcolumn operational | | no such table; no such column; unknown column; unknown table; does not exist in the schema
conflict | conflict integrity duplicatekey alreadyexists fileexists uniqueviolation | 409 eexist | already exists; duplicate key; duplicate entry; unique constraint; conflict
misused channel | | | send on closed channel; close of closed channel; close of nil channel
lock contention | deadlock locktimeout lock wouldblock | eagain ewouldblock | deadlock; all goroutines are asleep; lock wait; would block; could not obtain lock; database is locked
"""


def _causes() -> list[tuple[str, list[str], list[str], list[str]]]:
    rows = [[x.strip() for x in line.split("|")] for line in CAUSES.strip().splitlines()]
    return [(cause, types.split(), codes.split(), [p.strip() for p in phrases.split(";") if p.strip()]) for cause, types, codes, phrases in rows]


def normalised_error(text: Column) -> Column:
    """Error text with addresses, paths and numbers replaced, in that order, and white space squeezed."""
    out = F.regexp_replace(text, r"0x[0-9a-fA-F]+", "0xHEX")
    out = F.regexp_replace(out, r"[A-Za-z]:[\\/][^\s:'\",)\]]+", "/PATH")
    out = F.regexp_replace(out, r"/[^\s:]+", "/PATH")
    # most lines hold none of the three; whoever finds no mark of them looks no further
    out = F.when(F.contains(text, F.lit("0x")) | F.contains(text, F.lit("/")) | F.contains(text, F.lit("\\")), out).otherwise(text)
    out = F.regexp_replace(out, r"(?U)\d+", "N")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def fingerprint(text: Column) -> Column:
    """The first 12 hex digits of the normalised text's SHA-1; empty for empty or null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha1(normalised_error(text)), 1, 12))


def probable_cause(exception_type: Column, message: Column) -> Column:
    """The cause of the exception's type, or else the first cause of which the message holds a code or a phrase; null if none.

    A type counts by its last name: java.net.SocketTimeoutException is sockettimeout.
    """
    name = F.regexp_extract(F.lower(F.coalesce(exception_type, F.lit(""))), r"(?:^|[.:\\/])([^.:\\/\s]+)\s*$", 1)
    name = F.regexp_replace(name, r"(?<=.)(?:error|exception|fault)$", "")
    by_type = F.when(F.lit(False), F.lit(None).cast("string"))
    by_text = by_type
    text = F.lower(F.concat_ws(" ", exception_type, message))
    words = F.split(text, r"[^a-z0-9_]+")
    for cause, types, codes, phrases in _causes():
        if types:
            by_type = by_type.when(name.isin(types), F.lit(cause))
        signs = [F.arrays_overlap(words, F.array(*[F.lit(c) for c in codes]))] * bool(codes) + [F.contains(text, F.lit(p)) for p in phrases]
        if signs:
            any_sign = signs[0]
            for sign in signs[1:]:
                any_sign = any_sign | sign
            by_text = by_text.when(any_sign, F.lit(cause))
    return F.coalesce(by_type, by_text)


def trace_id(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, TRACE_ID, 1), F.lit(""))


def normalize_address(token: Column) -> Column:
    """Lower case, 0x in front, no leading zeros."""
    digits = F.regexp_replace(F.lower(F.trim(token)), r"^(0x)?0*", "")
    return F.concat(F.lit("0x"), F.when(digits == "", F.lit("0")).otherwise(digits))


def field_pairs(line: Column) -> Column:
    """All (key, value) of a line in order."""
    white = " \t\n\x0b\x0c\r"

    def halves(pair: Column) -> Column:
        # a key holds neither = nor :, so the first of them parts it from its value
        key = F.substring_index(F.translate(pair, ":", "="), "=", 1)
        return F.struct(F.rtrim(key, F.lit(white)).alias("key"), F.ltrim(F.substr(pair, F.length(key) + 2), F.lit(white)).alias("value"))

    return F.transform(F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(0)), halves)


def fields(line: Column) -> Column:
    """Key to value; of a repeated key the last, whatever the session says about repeated map keys."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(field_pairs(line), empty, lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def addresses(line: Column) -> Column:
    """Distinct addresses in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(HEX_TOKEN), F.lit(1)), normalize_address))


def numbers(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))


def value_address(value: Column) -> Column:
    """The first address in a value, or null."""
    found = F.regexp_extract(value, HEX_TOKEN, 1)
    return F.when(found != "", normalize_address(found))


def parse_bytes(text: Column, default: int = 0) -> Column:
    """'5GB' or '512' as bytes, in powers of 1024."""
    p = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)(?:i?B)?\s*$"
    unit = F.upper(F.regexp_extract(text, p, 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(text.rlike(p), (F.regexp_extract(text, p, 1).try_cast("double") * F.pow(F.lit(1024.0), power)).cast("long")).otherwise(F.lit(default).cast("long"))


def human_size(n: Column) -> Column:
    """Bytes with a unit, one decimal from kB on; null for null."""
    out = F.when(n.isNull(), F.lit(None).cast("string")).when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.format_string("%.1f " + unit, n / F.lit(float(1024**i))))
    return out.otherwise(F.format_string("%.1f TB", n / F.lit(float(1024**4))))


def text_tokens(n_chars: Column) -> Column:
    return F.ceil(n_chars / 4).cast("long")


def visual_tokens(width: Column, height: Column, edge: int = 2576, most: int = 4784) -> Column:
    """Patches of 28 pixels, at most `most`, after an image with a side beyond `edge` has been scaled down to it, each side cut to whole pixels but 1 at least. No size, no tokens."""
    long = F.greatest(width, height)
    scale = F.when(long > edge, F.lit(float(edge)) / long).otherwise(1.0)
    side = lambda x: F.greatest(F.floor(x * scale), F.lit(1))
    return F.when((width > 0) & (height > 0), F.least((F.ceil(side(width) / 28) * F.ceil(side(height) / 28)).cast("long"), F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long"))


def error_keywords(text: Column) -> Column:
    """Which error words the text holds when its white space is left out."""
    squashed = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.filter(F.array(*[F.lit(k) for k in ERROR_KEYWORDS]), lambda k: F.contains(squashed, k))


def screen_verdict(text: Column, available: Column) -> Column:
    """What reading a screen gave: found, none or unreadable."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(~available | blank, F.lit("unreadable")).when(F.size(error_keywords(text)) > 0, F.lit("found")).otherwise(F.lit("none"))


def is_failure_kind(kind: Column) -> Column:
    """Whether a word of the kind starts with a failure word."""
    words = F.split(F.lower(kind), "[^a-z0-9]+")
    return F.exists(words, lambda w: F.exists(F.array(*[F.lit(k) for k in FAILURE_KINDS]), lambda k: w.startswith(k)))


def logical_lines(text: Column) -> Column:
    """A block's lines, whether the breaks are real or spelt as backslash n."""
    return F.filter(F.split(text, r"\r?\n|\\n"), lambda x: F.trim(x) != "")


#: Causes by what a stack's files and functions are about, tried in order.
STACK_CAUSES = {"database": ["sql", "database", "cursor", "psycopg", "jdbc", "sqlite", "mongo"], "network": ["socket", "http", "urllib", "requests", "connection", "ssl"], "file": ["open(", "fileio", "os.path", "ioutil", "java.io", "fs."], "parsing": ["json", "parse", "decode", "yaml", "xml"], "concurrency": ["thread", "lock", "asyncio", "mutex", "channel", "pool"], "memory": ["alloc", "malloc", "heap", "buffer"]}


def stack_cause(trace: Column) -> Column:
    """What the stack is about, by words in it; null if nothing known."""
    low = F.lower(trace)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for cause, words in STACK_CAUSES.items():
        test = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(low, F.lit(w))
        out = out.when(test, F.lit(cause))
    return out


def error_lines(text: Column, limit: int = 5) -> Column:
    """Up to `limit` lines of a screen that hold an error word, white space within words left out of account."""
    words = F.array(*[F.lit(k) for k in ERROR_KEYWORDS])
    hit = lambda line: F.exists(words, lambda k: F.contains(F.lower(F.regexp_replace(line, r"\s+", "")), k))
    return F.slice(F.transform(F.filter(F.split(text, r"\r?\n"), hit), lambda x: F.trim(x)), 1, limit)


def enriched(message: Column, known: Column) -> Column:
    """The fields of an event with those its message names: what is known stays, then the embedded JSON object's, then key=value pairs; of a repeated key the first."""
    embedded = F.from_json(F.regexp_extract(message, r"(\{.*\})", 1), "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    first = F.aggregate(field_pairs(message), empty, lambda acc, p: F.when(F.map_contains_key(acc, p["key"]), acc).otherwise(F.map_concat(acc, F.create_map(p["key"], p["value"]))))
    less = lambda a, b: F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))
    return less(less(F.coalesce(known, empty), F.coalesce(embedded, empty)), first)
