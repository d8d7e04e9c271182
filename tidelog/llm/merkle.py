"""Merkle manifest of a dataset: one tree per part of it, and one over the parts' roots.

The nodes are stored outside memory, in Parquet, one folder a level. The leaves
are sorted into runs and numbered within their tree as they stream by; each level
reads the one before from front to back and writes the parents of every run of
`arity` nodes, so that nothing is shuffled but the few nodes of runs that an
edge between files cuts. A node's coordinate is its tree, its level and its place
in the level; its parent's place is its own divided by `arity`, so proofs are
merge joins of neighbouring levels by coordinate, from the roots down.

Digests are lowercase hex, and the digest of several is taken over their text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Children of a node, and nodes in a file of a small level.
ARITY, FILE_NODES = 3, 200_000
_NODE = "tree string, place long, nodes long, digest string"


def digest(*columns: str | Column) -> Column:
    """H of column values: `-` for null, else byte count, `:` and value."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """The leaves with place (from 0 in their tree, by `order` and digest) and nodes, the tree's number of leaves. Every task's run is sorted; a tree may span any number of runs."""
    spark = leaves.sparkSession

    def count(batches):
        run, tree, n = None, None, 0
        for batch in batches:
            ranks = []
            for t, r in zip(batch.column("tree").to_pylist(), batch.column("run").to_pylist()):
                run, n = r, n + 1 if (t, r) == (tree, run) else 0
                tree = t
                ranks.append(n)
            yield pa.record_batch([*batch.columns, pa.array(ranks, pa.int64())], [*batch.schema.names, "rank"])

    key = ["tree", *order, "digest"]
    runs = leaves.repartitionByRange(common.parts(spark), *key).sortWithinPartitions(*key).withColumn("run", F.spark_partition_id())
    runs = common.stored(runs.mapInArrow(count, T.StructType([*(T.StructField(f.name, f.dataType) for f in runs.schema), T.StructField("rank", T.LongType())])))
    sizes = runs.groupBy("tree", "run").agg(F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("run")
    offsets = sizes.select("tree", "run", (F.sum("size").over(before) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy("tree")).alias("nodes"))
    placed = runs.join(offsets, ["tree", "run"]).withColumn("place", F.col("before") + F.col("rank"))
    out = common.stored(placed.drop("run", "rank", "before").sortWithinPartitions("tree", "place"))
    common.deleted(runs)
    return out


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """(tree, place, nodes, digest, children) of the next level; trees of one node have no more. Reads the level's files front to back; a run of children that is cut by a file's edge is put together from its pieces."""

    def pair(batches):
        out: list = []
        held: list = []  # the children read so far of the run that is open
        at = None

        def close() -> None:
            tree, parent, nodes = at
            held.sort()  # files may be read in any order
            places = [p for p, _ in held]
            whole = len(held) == min(arity, nodes - parent * arity)
            children = [d for _, d in held]
            out.append((tree, parent, -(-nodes // arity), hashlib.sha256("".join(children).encode()).hexdigest() if whole else None, children, None if whole else places))

        for batch in batches:
            for tree, place, nodes, d in zip(*[batch.column(c).to_pylist() for c in ("tree", "place", "nodes", "digest")]):
                key = (tree, place // arity, nodes)
                if key != at:
                    if held:
                        close()
                    at, held = key, []
                held.append((place, d))
            if out:
                yield rows(out)
                out = []
        if held:
            close()
        if out:
            yield rows(out)

    def rows(found: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["tree", "place", "nodes", "digest", "children", "places"])

    found = common.stored(level.filter(F.col("nodes") > 1).select("tree", "place", "nodes", "digest").mapInArrow(pair, _NODE + ", children array<string>, places array<long>"))
    whole = found.filter(F.col("digest").isNotNull()).drop("places")
    pieces = found.filter(F.col("digest").isNull()).select("tree", "place", "nodes", F.explode(F.arrays_zip(F.col("places").alias("p"), F.col("children").alias("d"))).alias("c"))
    mended = pieces.groupBy("tree", "place", "nodes").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["d"]).alias("children"))
    mended = mended.select("tree", "place", "nodes", F.sha2(F.array_join("children", "").cast("binary"), 256).alias("digest"), "children")
    out = common.stored(whole.unionByName(mended).coalesce(1 + found.count() // FILE_NODES))
    common.deleted(found)
    return out


class Forest:
    """The stored levels of all trees; levels[0] holds the leaves with whatever columns they came with."""

    def __init__(self, leaves: DataFrame, order: list[str], arity: int = ARITY):
        """leaves: tree (no nulls), digest, the columns of `order`, and any others but place and nodes."""
        self.arity, self.levels = arity, [_numbered(leaves, order)]
        most = self.levels[0].agg(F.max("nodes")).first()[0] or 0
        while most > 1:
            self.levels.append(_parents(self.levels[-1], arity))
            most = -(-most // arity)

    def roots(self) -> DataFrame:
        """(tree, digest): the one node that is left of each tree."""
        tops = [level.filter(F.col("nodes") == 1).select("tree", "digest") for level in self.levels]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out

    def proofs(self) -> DataFrame:
        """The leaves with place, nodes and proof: for each level the text of the digests left and right of the node in its run."""
        step = "struct<left:string,right:string>"
        none = F.array().cast(f"array<{step}>")
        below = None
        for k in range(len(self.levels) - 1, -1, -1):
            nodes = self.levels[k]
            tops = nodes.filter(F.col("nodes") == 1).withColumn("proof", none)
            if below is not None:
                i = (F.col("place") % self.arity).cast("int")
                text = lambda a: F.array_join(a, "")
                sides = F.struct(text(F.slice("_children", F.lit(1), i)).alias("left"), text(F.slice("_children", i + 2, F.lit(self.arity))).alias("right"))
                up = below.select(F.col("tree").alias("_tree"), F.col("place").alias("_parent"), F.col("children").alias("_children"), F.col("proof").alias("_proof"))
                met = nodes.filter(F.col("nodes") > 1).withColumn("_at", F.floor(F.col("place") / self.arity).cast("long")).join(up.hint("merge"), (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col("_parent")))
                met = met.withColumn("proof", F.concat(F.array(sides.cast(step)), F.col("_proof"))).drop("_tree", "_at", "_parent", "_children", "_proof")
                tops = met.unionByName(tops)
            below = tops
        return below

    def release(self) -> None:
        common.deleted(*self.levels)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def siblings_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), F.lit(""), lambda acc, s: F.concat(acc, s)).cast("binary"), 256)


def manifest(rows: DataFrame, leaf: Column, part: str, order: list[str], arity: int = ARITY) -> DataFrame:
    """The rows with leaf, subroot, root and proof (the steps up to subroot and on to root); columns of these names and tree, digest, place and nodes are replaced.

    Each value of `part` (a string; null is one too, and first) is a tree over its rows in ascending `order`, nulls first; rows that agree in it stand in the
    order of their leaves. The trees' roots in order of part, by bytes, are the leaves of the last tree. One row alone is its own root. An empty table has no root and gives
    no rows.
    """
    own = ["leaf", "subroot", "root", "proof", "tree", "digest", "place", "nodes"]
    names = [c for c in rows.columns if c not in own]
    tree = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
    forest = Forest(rows.select(*names, leaf.alias("digest"), tree.alias("tree")), order, arity)
    top = Forest(forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest"), ["part"], arity)
    root = top.roots().first()
    parts = top.proofs().select(F.col("part").alias("tree"), F.col("digest").alias("subroot"), F.col("proof").alias("_upper"))
    out = forest.proofs().join(parts, "tree").withColumn("proof", F.concat("proof", "_upper"))
    return out.select(*names, F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")


def verified(leaf: Column, proof: Column, root: Column) -> Column:
    return folded(leaf, proof) == root


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof digest, and the root that its proof gives for its text, without line ends for ids whose crc32 is even (a null id has none)."""
    docs = common.read_table(spark, sf_dir, "documents")
    fields = lambda text: digest("doc_id", "source", "lang", "n_chars", text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", fields("text").alias("intact"), fields(tampered).alias("seen"))
    found = manifest(rows, F.col("intact"), "source", ["doc_id"])
    out = found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("seen"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text,
         CASE WHEN coalesce(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))) % 2 = 0, false)
              THEN replace(text, chr(10), '') ELSE text END AS seen
  FROM documents
), leaves AS (
  SELECT doc_id, tree, leaf, seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS nodes
  FROM (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS seen FROM docs)
), nodes AS (
  SELECT tree, 0 AS level, place, nodes, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 3, any_value((nodes + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE nodes > 1 GROUP BY tree, level, place // 3
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS nodes FROM nodes WHERE nodes = 1
), tops AS (
  SELECT 0 AS level, place, nodes, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, any_value((nodes + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE nodes > 1 GROUP BY level, place // 3
), runs AS (
  SELECT tree, level, place // 3 AS parent, list(digest ORDER BY place) AS d FROM nodes WHERE nodes > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, place // 3 AS parent, list(digest ORDER BY place) AS d FROM tops WHERE nodes > 1 GROUP BY ALL
), lower_steps AS (
  SELECT l.tree, l.place, list([array_to_string(r.d[1:i], ''), array_to_string(r.d[i + 2:3], '')] ORDER BY r.level) AS steps
  FROM (SELECT l.tree, l.place, r.level, r.d, (l.place // CAST(pow(3, r.level) AS BIGINT)) % 3 AS i FROM leaves l JOIN runs r ON r.tree = l.tree AND r.parent = l.place // CAST(pow(3, r.level + 1) AS BIGINT)) r
  JOIN leaves l ON l.tree = r.tree AND l.place = r.place GROUP BY ALL
), upper_steps AS (
  SELECT tree, list([array_to_string(d[1:i], ''), array_to_string(d[i + 2:3], '')] ORDER BY level) AS steps
  FROM (SELECT s.tree, r.level, r.d, (s.place // CAST(pow(3, r.level) AS BIGINT)) % 3 AS i FROM subroots s JOIN top_runs r ON r.parent = s.place // CAST(pow(3, r.level + 1) AS BIGINT)) GROUP BY ALL
), proofs AS (
  SELECT l.doc_id, l.leaf, l.seen, s.digest AS subroot, (SELECT digest FROM tops WHERE nodes = 1) AS root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON s.tree = l.tree LEFT JOIN lower_steps a ON a.tree = l.tree AND a.place = l.place LEFT JOIN upper_steps b ON b.tree = l.tree
), folds AS (
  SELECT *, list_reduce(list_prepend([seen], steps), lambda x, y: [sha256(y[1] || x[1] || y[2])])[1] AS folded_root FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(flatten(steps), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
