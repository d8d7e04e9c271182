"""Language identification by rank-order profiles of character n-grams.

A text becomes a sequence of letters in lower case in which every run of other
characters is one blank; its profile ranks the most frequent 1- to 3-grams. The
language whose profile has the smallest out-of-place distance wins.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ranks in a profile, of a language as of a document.
PROFILE = 400
#: Distinct n-grams that a learning task holds before it hands on its counts.
HELD_GRAMS = 500_000
#: A blank's code is no letter's and not 0, so that an n-gram that starts with one is not the shorter one after it.
_BITS, _BLANK = np.uint64(21), np.uint64(1)


@functools.cache
def _letters() -> np.ndarray:
    """Each code point's letter, 0 for what is none."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


def letter_codes(text: str) -> np.ndarray:
    """The letters of a text, a blank at both ends and for each run between letters."""
    codes = np.empty(len(lowered := text.lower()) + 2, np.uint64)
    codes[0] = codes[-1] = 0
    codes[1:-1] = _letters()[np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[0] = True
    return np.where(codes[keep] == 0, _BLANK, codes[keep])


def grams(codes: np.ndarray) -> np.ndarray:
    """Sorted keys of all 1- to 3-grams that hold a letter. A code of 0 parts texts; no n-gram spans it."""
    two = (codes[:-1] << _BITS) | codes[1:]
    three = (two[:-1] << _BITS) | codes[2:]
    parts = codes == 0
    if parts.any():
        apart = parts[:-1] | parts[1:]
        codes, two, three = codes[~parts], two[~apart], three[~(apart[:-1] | parts[2:])]
    keys = np.concatenate([codes, two, three])
    keys = keys[keys != _BLANK]
    keys.sort()
    return keys


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and how often, or with what weight, each occurs."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys))) if weights is None else np.add.reduceat(weights, at) if len(at) else np.zeros(0, np.int64)
    return keys[at], counts


def _count_grams(batches):
    held: dict[str, list] = {}

    def merged():
        for lang, lists in held.items():
            keys, counts = np.concatenate([k for k, _ in lists]), np.concatenate([c for _, c in lists])
            order = np.argsort(keys, kind="stable")
            held[lang] = [counted(keys[order], counts[order])]
        return sum(len(lists[0][0]) for lists in held.values())

    def out():
        for lang, ((keys, counts),) in held.items():
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    n = 0
    for piece in common.slices(batches, "text"):
        by: dict[str, list] = {}
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
            if text:
                by.setdefault(lang, []).append(letter_codes(text))
        for lang, codes in by.items():
            part = np.zeros(1, np.uint64)
            keys, counts = counted(grams(np.concatenate([x for c in codes for x in (c, part)])))
            held.setdefault(lang, []).append((keys, counts))
            n += len(keys)
        if n > 2 * HELD_GRAMS:
            n = merged()
            if n > HELD_GRAMS:
                yield from out()
                held, n = {}, 0
    if held:
        merged()
        yield from out()


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language from all rows of (lang, text); size keys a language come to the driver.

    Rows with a null lang or text teach nothing; equal counts rank by the n-gram's code points.
    """
    rows = labelled.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    found: dict[str, list] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(keys, np.uint64) for lang, keys in found.items()}


class Profiles:
    """The ranks of all profiled n-grams in every language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def best(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / the largest distance possible; equal distances go to the first by code point."""
        if not text or not self.langs:
            return "und", 0.0
        keys, counts = counted(grams(letter_codes(text)))
        if not len(keys):
            return "und", 0.0
        if len(keys) > self.size:
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            some = np.flatnonzero(counts >= least)
            keys, counts = keys[some], counts[some]
        keys = keys[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.keys, keys)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)] = len(self.keys)
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(keys), dtype=np.int32))).sum(axis=1)
        i = int(np.argmin(apart))
        return self.langs[i], float(1 - apart[i] / (self.size * len(keys)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """doc_id with lang_pred and score for each document, from the whole text alone.

    A null text, or one without letters, is `und` with score 0. Repeated rows get equal answers each.
    """
    model = Profiles(profiles, size)

    def predict(batches):
        for piece in common.slices(batches, "text"):
            found = [model.best(t) for t in piece.column("text").to_pylist()]
            yield pa.record_batch([piece.column("doc_id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """The documents whose language is known, all columns as they were; `und` goes and nothing else does. Without profiles that is a null text or one without a letter."""
    model = Profiles(profiles, size)
    known = (lambda t: model.best(t)[0] != "und") if model.langs else (lambda t: bool(t) and len(grams(letter_codes(t))) > 0)

    def keep(batches):
        for piece in common.slices(batches, "text"):
            yield piece.filter(pa.array([known(t) for t in piece.column("text").to_pylist()]))

    return docs.mapInArrow(keep, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(common.crc_fold(F.col("doc_id")) != 0).select("lang", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, by profiles of those outside the held-out fifth."""
    docs = common.read_table(spark, sf_dir, "documents")
    found = identify(docs, learn_profiles(training_rows(docs)))
    return found.select("doc_id", (common.crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
