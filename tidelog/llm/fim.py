"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is a row of units, the matches of a pattern from left to right. The first
pass counts them; the second advances a lazy iterator of matches to the two
ranks at which the text is cut, and stops there. No list of units, or of their
places, exists at any time, so beyond the text and its output the memory is
constant however many units there are.

The output holds the three parts behind sentinels, so that the text can be put
together again from output and form alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A unit: a line with its end.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: Iterable[str]) -> tuple[str, str, str]:
    """Sentinels that can be found again: none is empty, and none begins as it or another ends, so that no text beside one makes up another."""
    p, s, m = sentinels
    for (i, a), (j, b) in itertools.product(enumerate((p, s, m)), repeat=2):
        if not a or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (i != j))) or (i != j and a in b):
            raise ValueError(f"sentinels {a!r} and {b!r} could be taken for each other")
    return p, s, m


def count_units(pattern: re.Pattern, text: str) -> int:
    """First pass: the number of matches."""
    return sum(1 for _ in pattern.finditer(text))


def cut_places(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of ranks low and high end (low <= high, from 1; rank 0 ends at 0), by one iterator that goes no further."""
    matches, at = pattern.finditer(text), 0
    ends = []
    for steps in (low, high - low):
        for match in itertools.islice(matches, steps):
            at = match.end()
        ends.append(at)
    return ends[0], ends[1]


def draws(seed: int, doc_id) -> list[int]:
    """The first four 8-digit groups of sha256 of `seed:doc_id`, as unsigned integers; a null id is the empty text."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, unit: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Iterable[str] = SENTINELS) -> DataFrame:
    """The documents with n units, form, output and the code points of prefix and middle (null if plain); columns of those names are replaced, the others stay.

    Of 100 draws `rate` are cut and of those `spm` put the suffix first; the rest, empty and null texts, and texts that hold a sentinel stay plain. A null
    text has the empty output. Rows that repeat id and text are cut alike. What the pattern leaves between units stays with the unit after it, what it
    leaves at the end is suffix. Texts pass in slices; a very long one stands alone.
    """
    p, s, m = _checked(sentinels)
    added = ["n", "form", "output", "prefix_chars", "middle_chars"]
    rest = docs.drop(*added)
    pattern = re.compile(unit)

    def one(doc_id, text: str | None) -> tuple:
        text = text or ""
        n = count_units(pattern, text)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= rate:
            return n, "plain", text, None, None
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = cut_places(pattern, text, low, high)
        if h4 % 100 < spm:
            return n, "spm", "".join((s, text[b:], p, text[:a], m, text[a:b])), a, b - a
        return n, "psm", "".join((p, text[:a], s, text[b:], m, text[a:b])), a, b - a

    kinds = [pa.int64(), pa.string(), pa.large_string(), pa.int64(), pa.int64()]

    def run(batches):
        for piece in common.slices(batches, "text"):
            found = zip(*[one(i, t) for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist())])
            new = [pa.array(column, kind) for column, kind in zip(found, kinds)]
            new[2] = new[2].cast(pa.string()) if new[2].nbytes < 1 << 31 else new[2]
            yield pa.record_batch([*piece.columns, *new], [*piece.schema.names, *added])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rest.schema] + [T.StructField(name, kind()) for name, kind in zip(added, (T.LongType, T.StringType, T.StringType, T.LongType, T.LongType))])
    return rest.mapInArrow(run, schema)


def restored(form: Column, output: Column, sentinels: Iterable[str] = SENTINELS) -> Column:
    """The text that was transformed, from form and output."""
    p, s, m = _checked(sentinels)
    head = F.substring_index(output, m, 1)
    middle = F.substring_index(output, m, -1)
    first, second = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s)), F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    before = F.call_function("substring_index", head, second, F.lit(1)).substr(F.length(first) + 1, F.length(head))
    after = F.call_function("substring_index", head, second, F.lit(-1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(before, middle, after)).otherwise(F.concat(after, middle, before))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document cut at two lines, with digests of its output and of the text that is restored from it."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = transform(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents
), ranks AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || substr(digits, 1, 8) AS UBIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(digits, 9, 8) AS UBIGINT) % (len(u) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(digits, 17, 8) AS UBIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(digits, 25, 8) AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(r1, r2)], '') AS prefix, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle, array_to_string(u[greatest(r1, r2) + 1:n], '') AS suffix
  FROM ranks
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
