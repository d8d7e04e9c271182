"""A training corpus from raw documents, in five stages.

Language identification drops documents without a language; line deduplication
drops lines (and documents made of such lines alone) that an earlier one copies;
the Jaccard join keeps one document of each group of near-duplicates; mixing
brings the sources to their weights, repeating or cutting; encoding turns what is
left into tokens. Each stage works on all rows that the one before kept.

All stages take an empty table, nulls in any column, empty and very long texts,
repeated rows and ids, and columns with any other names, which stay as they are.
A null id is an id like any other, but for the Jaccard join, where such rows link
with nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, common, jaccard, language, lines, mixing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by profiles learned from the labelled rows of these documents.

    Null texts and texts without a letter go; equal distances go to the language that is first by code point. Repeated rows are judged alike.
    """
    return language.with_language(docs, language.learn_profiles(language.training_rows(docs)))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line's first copy only, in order of (doc_id, line), null ids first.

    Null texts, and texts of which no line with a word is left, go. Of rows that repeat an id and a text one is first.
    """
    return lines.documents_without_copies(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that 5-word shingles link at a Jaccard similarity of 0.75.

    Texts without words link with nothing and stay. Rows that repeat an id count as one document, and one of them stays.
    """
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times.

    Documents of no words are taken 0 times; a null source is a source of its own. Rows that agree in id, source and size are taken alike; ties in virtual time go by source, place in the queue, id and size.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null or empty text has no tokens."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Mixing and encoding are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
            common.release(before)
    return docs
