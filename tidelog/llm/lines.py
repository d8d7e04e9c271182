"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

The unit of an edit is a word. Two lines are copies if their words are equal, or
if both have at least `min_words` words and inserting, deleting or replacing one
word turns one into the other. A line goes if an earlier line, in order of
(doc_id, line number), is a copy of it; lines without words stay.

Each distinct line that has a chance emits the hash of its words without the
i-th, for every i, and of all its words. Equal hashes at the same i are a
replacement, the whole of one line among the deletions of another is an
insertion or deletion. Only lines have a chance of which another has the first
or the last half word for word, as one edit leaves one of the halves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words that a line must have for one edit to be forgiven.
MIN_WORDS = 10


def _plain(line: Column) -> Column:
    """A line's words joined by one space."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def _mark() -> Column:
    """Tells rows that repeat an id apart by their text."""
    return F.xxhash64("text")


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, line) of every line with a word; lines end at \\n and count from 0."""
    lines = docs.select("doc_id", _mark().alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def first_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(line_id, line_id2, doc_id, line_no, mark, n, ends): distinct lines by their words, where each stands first, its number of words, and for lines of min_words hashes of its halves.

    Hashes alone travel, no text. Of rows that repeat an id with other texts, the one with the smaller hash of its text is earlier at the same line number.
    """
    text = F.col("text")
    lines = document_lines(docs).select("doc_id", "mark", "line_no", _plain(F.col("line")).alias("text")).withColumn("n", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("int"))
    small = F.floor((F.col("n") - 1) / 2).cast("int")
    large = F.floor(F.col("n") / 2).cast("int")
    lines = lines.withColumn("small", small).withColumn("large", large)
    half = lambda end, h: F.when(F.col("n") >= min_words, F.xxhash64(F.lit(end), F.col(h), F.expr(f"substring_index(text, ' ', {'-' if end else ''}{h})")))
    lines = lines.select(F.xxhash64(text).alias("line_id"), F.xxhash64(text, F.lit(1)).alias("line_id2"), "doc_id", "line_no", "mark", "n", half(0, "small").alias("p0"), half(1, "small").alias("s0"), half(0, "large").alias("p1"), half(1, "large").alias("s1"))
    out = lines.groupBy("line_id", "line_id2").agg(F.min(F.struct("doc_id", "line_no", "mark")).alias("first"), *[F.max(c).alias(c) for c in ("n", "p0", "s0", "p1", "s1")])
    return out.select("line_id", "line_id2", "first.doc_id", "first.line_no", "first.mark", "n", "p0", "s0", "p1", "s1")


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether the edit distance of two lists of words is at most one: their common ends cover all but one word of the longer."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)

    def equal_run(x: Column, y: Column) -> Column:
        differ = F.array_position(F.zip_with(F.slice(x, 1, short), F.slice(y, 1, short), lambda p, q: p != q), True)
        return F.when(differ > 0, differ - 1).otherwise(short)

    front, back = equal_run(a, b), equal_run(F.reverse(a), F.reverse(b))
    return (F.abs(n - m) <= 1) & (front + back >= F.greatest(n, m) - 1)


def edited_copies(docs: DataFrame, lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """line_id, line_id2 of the distinct `lines` of which an earlier one is a word apart."""
    key = ["line_id", "line_id2"]
    known = lines.filter(F.col("n") >= min_words)
    # lines that share a half with another: front and back say which
    ends = known.select("line_id", F.explode(F.array_distinct(F.array(*[F.struct(F.lit(c[0] == "p").alias("front"), F.col(c).alias("half")) for c in ("p0", "p1", "s0", "s1")]))).alias("e")).select("line_id", "e.*")
    shared = ends.groupBy("half").agg(F.min("line_id").alias("low"), F.max("line_id").alias("high")).filter(F.col("low") < F.col("high")).select("half")
    chance = ends.join(shared, "half").groupBy("line_id").agg(F.bool_or("front").alias("front"), F.bool_or(~F.col("front")).alias("back"))
    chance = common.stored(known.select(*key, "doc_id", "line_no").join(chance, "line_id"))
    # their words, from the documents where they stand first
    wanted = chance.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("line_no", *key, "front", "back")).alias("wanted"))
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
    words = F.split(_plain(F.get("all", F.col("w.line_no"))), " ")
    found = found.select("w.*", "doc_id", words.alias("words")).filter(F.xxhash64(F.array_join("words", " ")) == F.col("line_id"))
    found = common.stored(found.dropDuplicates(key))
    n = F.size("words")
    # variants: all words (place 0), and the words without the i-th (place i) where an edit can be: beyond the shared half
    may = lambda i: (F.col("front") & (i > F.floor((n - 1) / 2))) | (F.col("back") & (i <= n - F.floor((n - 1) / 2)))
    places = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), n), may))
    variant = F.when(F.col("place") == 0, F.xxhash64(F.array_join("words", " "))).otherwise(F.xxhash64(F.array_join(F.concat(F.slice("words", F.lit(1), F.greatest(F.col("place") - 1, F.lit(0))), F.slice("words", F.col("place") + 1, n)), " ")))
    variants = found.select(*key, "doc_id", "line_no", "words", F.explode(places).alias("place")).select(*key, "doc_id", "line_no", "place", variant.alias("variant"))
    variants = common.stored(variants)
    equal = variants.groupBy("variant").agg(F.min("line_id").alias("low"), F.max("line_id").alias("high")).filter(F.col("low") < F.col("high")).select("variant")
    variants = common.stored(variants.join(equal, "variant"))
    me = F.struct("doc_id", "line_no", *key)
    # the earliest line with each variant at each place, and the earliest that is whole or has lost a word
    same = variants.filter(F.col("place") > 0).groupBy("variant", "place").agg(F.min(me).alias("earliest"))
    side = variants.groupBy("variant").agg(F.min(F.when(F.col("place") == 0, me)).alias("whole"), F.min(F.when(F.col("place") > 0, me)).alias("cut"))
    replaced = variants.join(common.stored(same), ["variant", "place"]).select(me.alias("me"), "earliest")
    shifted = variants.join(common.stored(side), "variant").select(me.alias("me"), F.when(F.col("place") == 0, F.col("cut")).otherwise(F.col("whole")).alias("earliest"))
    pairs = replaced.union(shifted).filter(F.col("earliest").isNotNull() & (F.struct("earliest.doc_id", "earliest.line_no") < F.struct("me.doc_id", "me.line_no"))).select("me.line_id", "me.line_id2", F.col("earliest.line_id").alias("o1"), F.col("earliest.line_id2").alias("o2")).distinct()
    mine, other = found.select(*key, "words"), found.select(F.col("line_id").alias("o1"), F.col("line_id2").alias("o2"), F.col("words").alias("other"))
    return pairs.join(mine, key).join(other, ["o1", "o2"]).filter(one_word_apart(F.col("words"), F.col("other"))).select(*key).distinct()


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, kept): the numbers of the lines with words that stay, for texts that keep any."""
    lines = common.stored(first_lines(docs, min_words))
    gone = common.stored(edited_copies(docs, lines, min_words))
    left = lines.select("line_id", "line_id2", "doc_id", "mark", "line_no").join(gone, ["line_id", "line_id2"], "left_anti")
    return left.groupBy("doc_id", "mark").agg(F.collect_list("line_no").alias("kept"))


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with __turn: 1, and for rows that repeat both id and text 1, 2 and so on, in order of their other columns."""
    key = [F.col("doc_id").alias("__id"), _mark().alias("__mark")]
    again = common.stored(docs.groupBy(*key).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > 1).drop("__rows"))
    if again.isEmpty():
        return docs.withColumn("__turn", F.lit(1))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (_mark() == F.col("__mark"))
    turn = F.row_number().over(Window.partitionBy("doc_id", _mark()).orderBy(F.xxhash64(*docs.columns)))
    return docs.join(again, same, "left_anti").withColumn("__turn", F.lit(1)).unionByName(docs.join(again, same, "left_semi").withColumn("__turn", turn))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of the documents, text without the lines that an earlier line copies; null texts stay null.

    Of rows that repeat both id and text one keeps its lines, the others lose all with words.
    """
    kept = kept_lines(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("kept").alias("__kept"))
    rows = _numbered(docs)
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("__id")) & (_mark() == F.col("__mark")) & (F.col("__turn") == 1), "left").withColumn("__lines", F.split("text", "\n"))
    blank = F.filter(F.transform("__lines", lambda line, i: F.when(~line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    stays = F.array_sort(F.concat(F.coalesce("__kept", F.array().cast("array<int>")), blank))
    text = F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n")
    return joined.select(*[text.alias("text") if c == "text" else rows[c] for c in docs.columns])


def documents_without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same without the documents that had words and have none left; n_chars, where there is one, follows the text."""
    found = deduplicated(docs, min_words)
    out = found.filter(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines with words before and after, and the digest of what is left."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = deduplicated(docs.withColumn("before", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))))
    after = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return found.select("doc_id", F.greatest(F.col("before"), F.lit(0)).cast("long").alias("n_lines"), F.greatest(after, F.lit(0)).cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), split AS (
  SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM raw
), firsts AS (
  SELECT w, min((doc_id, line_no)) AS first FROM split WHERE len(w) > 0 GROUP BY w
), long AS (
  SELECT w, first, array_to_string(w, ' ') AS whole, len(w) AS n FROM firsts WHERE len(w) >= 10
), variants AS (
  SELECT w, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)
), gone AS (
  SELECT a.w FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND b.first < a.first
  UNION SELECT a.w FROM variants a JOIN long b ON a.v = b.whole AND b.first < a.first
  UNION SELECT a.w FROM long a JOIN variants b ON b.v = a.whole AND b.first < a.first
), kept AS (
  SELECT s.doc_id, s.line_no, s.line, len(s.w) AS n,
         len(s.w) = 0 OR ((s.doc_id, s.line_no) = f.first AND g.w IS NULL) AS stays
  FROM split s LEFT JOIN firsts f ON s.w = f.w LEFT JOIN (SELECT DISTINCT w FROM gone) g ON s.w = g.w
)
SELECT d.doc_id, count(*) FILTER (WHERE k.n > 0) AS n_lines, count(*) FILTER (WHERE k.n > 0 AND k.stays) AS n_kept,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no) FILTER (WHERE k.stays), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""
