"""Fuzzy search for short licence notices.

A text becomes its words in lower case, one blank between them. A notice that may
have k edits is split into k + 1 pieces; whatever is within k edits of the notice
holds one of the pieces unchanged (pigeonhole). One automaton finds all pieces of
all notices in one pass, which locates candidates: spans of whole words around a
piece. The `regex` library's matching with a bound on errors then says which
spans are within k edits, and how many there are.

Words are runs of ASCII letters and digits and of everything beyond ASCII; only
A-Z are lower-cased. An edit inserts, deletes or replaces one character of the
words or of the blanks between them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The base phrases and their labels, found word for word.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices of public licences as they name themselves, and short names for them.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("apache license", "apache"),
    ("mit license", "mit"),
    ("mit licence", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("isc license", "isc"),
    ("isc licence", "isc"),
    ("bsd license", "bsd"),
    ("bsd licence", "bsd"),
    ("2 clause bsd license", "bsd-2-clause"),
    ("bsd 2 clause license", "bsd-2-clause"),
    ("3 clause bsd license", "bsd-3-clause"),
    ("bsd 3 clause license", "bsd-3-clause"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("boost software license", "bsl"),
    ("artistic license", "artistic"),
    ("zlib license", "zlib"),
    ("python software foundation license", "psf"),
    ("open data commons", "odc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: A notice of so many characters is forgiven an edit, one of twice as many two, and so on up to MOST_EDITS.
CHARACTERS_AN_EDIT, MOST_EDITS = 12, 3

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLANKS = re.compile(rb" {2,}")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> str:
    """The words of a text in lower case with one blank between them."""
    return _BLANKS.sub(b" ", (text or "").encode("utf-8", "replace").translate(_PLAIN)).strip(b" ").decode()


def allowed_edits(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARACTERS_AN_EDIT)


class Finder:
    """All notices' pieces in one automaton, and each notice's bounded matcher. notices: (words with one blank between them, label, edits)."""

    def __init__(self, notices: Iterable[tuple[str, str, int]]):
        self.notices, pieces = tuple(notices), {}
        self.matchers = []
        for i, (notice, _, k) in enumerate(self.notices):
            if not notice or plain_words(notice) != notice or k < 0 or len(notice) <= k:
                raise ValueError(f"{notice!r} with {k} edits is no notice: lower-case words with one blank between them, longer than the edits")
            self.matchers.append(regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}") if k else None)
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(notice[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton() if pieces else None
        self.edits = functools.lru_cache(1 << 14)(self._edits)

    def _edits(self, i: int, span: str) -> int:
        """Edits between a notice and a span, -1 for more than its bound."""
        notice, _, k = self.notices[i]
        if span == notice or not k:
            return 0 if span == notice else -1
        found = self.matchers[i].fullmatch(span)
        return sum(found.fuzzy_counts) if found else -1

    def spans(self, words: str) -> dict[tuple[int, int, int], int]:
        """(notice, start, end) in characters of all spans of whole words within a notice's edits, with their edits."""
        found, tried = {}, set()
        for last, (size, owners) in self.automaton.iter(words) if self.notices else ():
            at = last + 1 - size
            for i, offset in owners:
                notice, _, k = self.notices[i]
                start = at - offset
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                end = start + len(notice)
                if not k:
                    starts, ends = (start,), (end,)
                else:
                    starts, ends = range(max(0, start - k), start + k + 1), range(max(1, end - k), min(len(words), end + k) + 1)
                ends = [b for b in ends if b == len(words) or (b < len(words) and words[b] == " " and words[b - 1] != " ")]
                for a in starts if ends else ():
                    if a < 0 or (a > 0 and words[a - 1] != " ") or (a < len(words) and words[a] == " "):
                        continue
                    for b in ends:
                        if a < b and abs(b - a - len(notice)) <= k and (i, a, b) not in found and (edits := self.edits(i, words[a:b])) >= 0:
                            found[i, a, b] = edits
        return found

    def hits(self, words: str, spans: dict[tuple[int, int, int], int]) -> list[tuple[str, str, int, int, int, int, int]]:
        """(label, notice, first word, words, start, end, edits) in order of place: of a notice's spans that overlap the one with fewest edits, then the earliest, then the shortest."""
        by_notice: dict[int, list] = {}
        for (i, a, b), edits in spans.items():
            by_notice.setdefault(i, []).append((edits, a, b))
        kept = []
        for i, spans in by_notice.items():
            taken = _Taken()
            kept += [(a, b, i, edits) for edits, a, b in sorted(spans) if taken.take(a, b)]
        out, word, at = [], 0, 0
        for a, b, i, edits in sorted(kept):
            word, at = word + words.count(" ", at, a), a
            out.append((self.notices[i][1], self.notices[i][0], word, words.count(" ", a, b) + 1, a, b, edits))
        return out


class _Taken:
    """Ranges that do not overlap, by their cells of a fixed width."""

    def __init__(self, width: int = 64):
        self.width, self.cells = width, {}

    def take(self, a: int, b: int) -> bool:
        cells = range(a // self.width, (b - 1) // self.width + 1)
        if any(x < b and a < y for c in cells for x, y in self.cells.get(c, ())):
            return False
        for c in cells:
            self.cells.setdefault(c, []).append((a, b))
        return True


def all_places(words: str, phrases: Iterable[tuple[str, str]], found: dict, notices: tuple) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase stands word for word, overlapping ones too, out of the spans found."""
    labels = dict(phrases)
    return sorted({(a, notices[i][0]) for (i, a, b), edits in found.items() if not edits and notices[i][0] in labels})


@functools.lru_cache(4)
def finder(notices: tuple[tuple[str, str, int], ...]) -> Finder:
    return Finder(notices)


def default_notices(edits: bool = True) -> tuple[tuple[str, str, int], ...]:
    """The base phrases and the notices, each with the edits that its length allows (or none); a phrase in both stands once."""
    return tuple((n, label, allowed_edits(n) if edits else 0) for n, label in dict.fromkeys((*BASE, *NOTICES)))


HIT = T.StructType([T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
BASE_HIT = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("label", T.StringType())])


def scan(docs: DataFrame, notices: tuple[tuple[str, str, int], ...] | None = None, phrases: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """The documents with n_words, hits (label, notice, first_word, words, start and end in code points of the text, edits) and places (first_word, label of each place of a phrase); columns of those names are replaced.

    Hits of one notice do not overlap; hits of different notices may. A null or empty text, or one without words, has none. Repeated rows are scanned
    each. Phrases must be among the notices. Texts pass in slices, a very long one by itself.
    """
    notices = default_notices() if notices is None else tuple(notices)
    missing = {p for p, _ in phrases} - {n for n, _, _ in notices}
    if missing:
        raise ValueError(f"phrases that are no notices: {sorted(missing)}")
    added = ["n_words", "hits", "places"]
    rest = docs.drop(*added)
    labels = dict(phrases)

    def one(found: Finder, text: str | None) -> tuple:
        words = plain_words(text)
        n = words.count(" ") + 1 if words else 0
        spans = found.spans(words)
        if not spans:
            return n, [], []
        hits, places, word, at = found.hits(words, spans), [], 0, 0
        for a, notice in all_places(words, phrases, spans, notices):
            word, at = word + words.count(" ", at, a), a
            places.append((word, labels[notice]))
        # where the hits' words stand in the text as it came
        wanted, where = {w for h in hits for w in (h[2], h[2] + h[3] - 1)}, {}
        for i, m in enumerate(_WORD.finditer(text)):
            if i in wanted:
                where[i] = m.span()
                if len(where) == len(wanted):
                    break
        return n, [{"label": h[0], "notice": h[1], "first_word": h[2], "words": h[3], "start": where[h[2]][0], "end": where[h[2] + h[3] - 1][1], "edits": h[6]} for h in hits], [{"first_word": w, "label": label} for w, label in places]

    arrow = lambda kind: pa.list_(pa.struct([(f.name, {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}[type(f.dataType)]) for f in kind]))

    def run(batches):
        found = finder(notices)
        for piece in common.slices(batches, "text"):
            n, hits, places = zip(*[one(found, t) for t in piece.column("text").to_pylist()])
            yield pa.record_batch([*piece.columns, pa.array(n, pa.int64()), pa.array(hits, arrow(HIT)), pa.array(places, arrow(BASE_HIT))], [*piece.schema.names, *added])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rest.schema] + [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT)), T.StructField("places", T.ArrayType(BASE_HIT))])
    return rest.mapInArrow(run, schema)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with the places of the base phrases and the labels of all notices within their edits; score: 1 for a notice without edits, less by the share of characters edited of the best, 0 without notice."""
    found = scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    labels = F.concat(base, F.transform("hits", lambda h: h["label"]))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("places", lambda p: p["first_word"])
    likeness = F.transform("hits", lambda h: 1 - h["edits"] / F.length(h["notice"]))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(labels).alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"), "hits")
