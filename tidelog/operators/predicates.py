"""Predicates as data: a table of standing watches, or a vocabulary of patterns, against every row in one scan.

Each pattern has a set of words of which any match holds one. One automaton per
worker finds all words of all patterns in one pass over a text, and a pattern runs
only where one of its words has been found; patterns without such words run on
every row that their other fields let through. The table of predicates goes to
the tasks whole, so its size is checked.
"""

from __future__ import annotations

import functools
import re
from re import _constants as sre
from re import _parser as sre_parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Predicates that may go to the tasks, and characters that a pattern may have.
MOST_PREDICATES, MOST_CHARACTERS = 100_000, 2000
FIELDS = ("category", "level", "source")


def _needed(tokens) -> frozenset[str] | None:
    """Words of which every match of the tokens holds one; None if there are none."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in [*tokens, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if op is sre.AT:  # takes no room, so the run goes on
            continue
        if run:
            found.append(frozenset([run.casefold()]))
            run = ""
        inner = None
        if op is sre.SUBPATTERN:
            inner = _needed(arg[3])
        elif op is sre.ATOMIC_GROUP:
            inner = _needed(arg)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = _needed(arg[2])
        elif op is sre.BRANCH:
            sides = [_needed(side) for side in arg[1]]
            inner = frozenset().union(*sides) if all(sides) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda words: min(map(len, words)), default=None)


@functools.lru_cache(1 << 12)
def needed_words(pattern: str) -> frozenset[str] | None:
    """Words, in folded case, of which every match of a pattern holds one; None where a match needs none."""
    return _needed(sre_parser.parse(pattern, re.IGNORECASE | re.MULTILINE))


class Patterns:
    """Numbered patterns behind one automaton of their words. A pattern that does not compile is looked for as it stands."""

    def __init__(self, patterns: list[str]):
        self.compiled, self.always, owners = [], [], {}
        for i, pattern in enumerate(patterns):
            try:
                compiled = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
            except re.error:
                pattern = re.escape(pattern)
                compiled = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
            self.compiled.append(compiled)
            words = needed_words(pattern)
            for word in words or ():
                owners.setdefault(word, []).append(i)
            if not words:
                self.always.append(i)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton()
            for word, of in owners.items():
                self.automaton.add_word(word, (word, of))
            self.automaton.make_automaton()
        self.runs = 0

    def candidates(self, text: str) -> list[int]:
        """The patterns that can match, in order."""
        out, seen = set(self.always), set()
        for _, (word, of) in self.automaton.iter(text.casefold()) if self.automaton else ():
            if word not in seen:
                seen.add(word)
                out.update(of)
        return sorted(out)

    def counts(self, text: str) -> dict[int, int]:
        """Matches of each pattern that has any."""
        out = {}
        for i in self.candidates(text):
            self.runs += 1
            n = sum(1 for _ in self.compiled[i].finditer(text))
            if n:
                out[i] = n
        return out


class Watches:
    """Standing watches (name, category, level, source, regex): an empty field holds of every row."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.patterned = [i for i, r in enumerate(rows) if r[4]]
        self.patterns = Patterns([rows[i][4] for i in self.patterned])
        self.plain: dict[tuple, list[int]] = {}
        for i, r in enumerate(rows):
            if not r[4]:
                self.plain.setdefault(tuple(x or None for x in r[1:4]), []).append(i)
        self.shapes = sorted({tuple(x is not None for x in key) for key in self.plain})

    def hits(self, fields: tuple, text: str | None) -> list[str]:
        """Names of the watches that a row meets."""
        out = [i for shape in self.shapes for i in self.plain.get(tuple(x if used else None for x, used in zip(fields, shape)), ())]
        for j in self.patterns.candidates(text or "") if self.patterned and text is not None else ():
            i = self.patterned[j]
            if all(not want or want == x for want, x in zip(self.rows[i][1:4], fields)) and self.patterns.compiled[j].search(text):
                out.append(i)
        return [self.rows[i][0] for i in sorted(out)]


def collected(table: DataFrame, columns: list[str], most: int = MOST_PREDICATES) -> list[tuple]:
    """The predicates as rows on the driver; more than `most`, or one of a huge pattern, is an error, not cut."""
    rows = [tuple(r) for r in table.select(*columns).orderBy(*columns).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} predicates")
    if any(len(r[-1] or "") > MOST_CHARACTERS for r in rows):
        raise ValueError(f"a pattern has more than {MOST_CHARACTERS} characters")
    return rows


def watch_hits(events: DataFrame, watches: DataFrame, keep: list[str], text: str = "props") -> DataFrame:
    """(keep..., watch) for each row of events (category, level, source, text) and each watch that it meets, on a batch or a stream.

    watches: a table (name, category, level, source, regex); null and empty fields hold of every row, the regex is looked for in any case of letters.
    """
    rows = collected(watches, ["name", *FIELDS, "regex"])
    schema = T.StructType([*(events.schema[c] for c in keep), T.StructField("watch", T.StringType())])

    def run(batches):
        table = Watches(rows)
        for batch in batches:
            at, names = [], []
            for i, (fields, value) in enumerate(zip(zip(*[batch.column(f).to_pylist() for f in FIELDS]), batch.column("_text").to_pylist())):
                for name in table.hits(fields, value):
                    at.append(i)
                    names.append(name)
            if at:
                kept = batch.take(pa.array(at, pa.int64()))
                yield pa.record_batch([*[kept.column(f"_k{j}") for j in range(len(keep))], pa.array(names, pa.string())], [*keep, "watch"])

    return events.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(keep)], *[F.col(f).cast("string").alias(f) for f in FIELDS], F.col(text).alias("_text")).mapInArrow(run, schema)


def watch_totals(hits: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """(watch, hits, first_ms, last_ms); on a stream for update mode, where each batch gives the watches that it has met with their totals so far."""
    return hits.groupBy("watch").agg(F.count("*").alias("hits"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))


def pattern_counts(files: DataFrame, path: str, text: str, vocabulary: dict[str, str]) -> DataFrame:
    """(signal, path, hits): matches of each pattern of a vocabulary in each text that has any."""
    if len(vocabulary) > MOST_PREDICATES:
        raise ValueError(f"more than {MOST_PREDICATES} patterns")
    names, patterns = list(vocabulary), list(vocabulary.values())

    def run(batches):
        table = Patterns(patterns)
        for batch in batches:
            rows = [(names[i], p, n) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) if t for i, n in table.counts(t).items()]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["signal", "path", "hits"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInArrow(run, "signal string, path string, hits long")


def signal_report(files: DataFrame, path: str, text: str, vocabulary: dict[str, str]) -> DataFrame:
    """(signal, hits, files, example) of a vocabulary over a tree of texts."""
    return pattern_counts(files, path, text, vocabulary).groupBy("signal").agg(F.sum("hits").alias("hits"), F.count("*").alias("files"), F.min("path").alias("example"))
