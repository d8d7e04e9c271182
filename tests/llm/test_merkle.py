"""op12: trees, proofs and tampering against a plain version in memory, and edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm import merkle


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_of(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, arity=3):
    """Root and each leaf's proof, a list of (left, right)."""
    proofs, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(places):
            run = level[p // arity * arity : p // arity * arity + arity]
            proofs[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
        places = [p // arity for p in places]
    return level[0], proofs


def by_force(rows):
    parts = {}
    for row in rows:
        parts.setdefault(row[1], []).append(row)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, leaf_of(*r)), r) for r in parts[name])
        trees[name] = leaves, *plain_tree([x[0][2] for x in leaves])
    root, upper = plain_tree([trees[n][1] for n in names])
    out = []
    for name, up in zip(names, upper):
        leaves, subroot, proofs = trees[name]
        for (key, r), proof in zip(leaves, proofs):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[4].replace("\n", "") if even and r[4] is not None else r[4]
            fold = leaf_of(*r[:4], text)
            for left, right in proof + up:
                fold = h(left, fold, right)
            out.append((r[0], key[2], subroot, root, h(*(a + b for a, b in proof + up)), fold, fold == root))
    return out


def rows_of_all_kinds():
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(4)}" if i % 3 else "hot", rng.choice(["en", None]), i, rng.choice(["a\nb", "x", None, "", "ü\n" * rng.randint(1, 9)])) for i in range(400)]
    rows += [(None, "hot", None, None, None), (None, None, None, None, None), (7, None, "en", 1, "z\n"), (8, None, "en", 1, "z\n"), (5, "hot", "en", 5, "two\nrows"), (5, "hot", "en", 5, "two\nrows"), (1 << 61, "", "", 0, ""), (-9, "one leaf", "de", -1, "\n"), (3, "é", "x", 2, "y" * 100_000), (9, "\U0001f600", None, 1, "k")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_plain_trees(spark, tmp_path):
    rows = rows_of_all_kinds()
    spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", leaf string, place int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    found = sorted((tuple(r) for r in got.collect()), key=key)
    assert found == sorted(by_force(rows), key=key)
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
@pytest.mark.parametrize("arity", [2, 3, 5])
def test_small_trees_and_other_arities(spark, n, arity):
    if n > 10 and arity != 2 or n in (4, 9) and arity == 5:
        pytest.skip("the same again")
    rows = spark.range(n).select("id", F.lit("p").alias("part"), F.col("id").cast("string").alias("text"))
    got = merkle.manifest(rows, merkle.digest("id", "text"), "part", ["id"], arity).orderBy("id").collect()
    leaves = [leaf_of(i, str(i)) for i in range(n)]
    root, proofs = plain_tree(leaves, arity)
    assert [(r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in got] == [(d, root, root, p) for d, p in zip(leaves, proofs)]


def test_pieces_of_runs_in_any_order_of_files(spark):
    """Files of one node each, read in whatever order."""
    rows = spark.createDataFrame([("t", i, 20, f"{i:02}") for i in range(20)], "tree string, place long, nodes long, digest string").repartition(20)
    from tidelog.llm import common

    got = {r["place"]: (r["digest"], r["nodes"], r["children"]) for r in merkle._parents(common.stored(rows), 3).collect()}
    assert got == {p: (h(*(f"{i:02}" for i in range(3 * p, min(20, 3 * p + 3)))), 7, [f"{i:02}" for i in range(3 * p, min(20, 3 * p + 3))]) for p in range(7)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.op12_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_a_changed_sibling_or_leaf_fails(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") < 20, "a").alias("part"))
    got = merkle.manifest(rows, merkle.digest("id"), "part", ["id"]).cache()
    assert got.filter(~merkle.verified(F.col("leaf"), F.col("proof"), F.col("root"))).count() == 0
    assert got.filter(merkle.verified(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof"), F.col("root"))).count() == 0
    wrong = F.transform("proof", lambda s, i: F.when(i == 0, F.struct(F.concat(s["left"], F.lit("0")).alias("left"), s["right"].alias("right"))).otherwise(s))
    assert got.filter(merkle.verified(F.col("leaf"), wrong, F.col("root"))).count() == 0
