"""op8: small tiles cost little: those of one document are not built, the others come one after another from sorted frames."""

import numpy as np
import pandas as pd
import pytest

from tidelog.llm import jaccard, pack


def test_tiles_of_one_document_are_not_built(spark):
    led = spark.createDataFrame([(1, 1), (3, 1), (2, 2), (4, 2), (5, 4), (7, 7), (9, 9)], "doc_id long, leader long")
    homes, places = jaccard.tiled(jaccard.common.stored(led))
    assert sorted((r["doc_id"], r["leader"]) for r in homes.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 4), (7, 7), (9, 9)]
    assert sorted((r["doc_id"], r["leader"], r["part"]) for r in places.collect()) == [(1, 1, 0), (2, 2, 0), (3, 1, 0), (4, 2, 0), (4, 4, 0), (5, 4, 0)]


def test_a_leader_is_in_every_part_of_its_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    _, places = jaccard.tiled(jaccard.common.stored(spark.range(10, 30).selectExpr("id AS doc_id", "10L AS leader")))
    rows = places.collect()
    assert {r["part"] for r in rows if r["doc_id"] == 10} == set(range(5)) and {r["doc_id"] for r in rows} == set(range(10, 30))
    assert len(rows) == 20 + 4


def sets_of(rng, rows: int) -> list[np.ndarray]:
    base = rng.integers(1, 1 << 63, 80, dtype=np.uint64)
    return [jaccard.distinct(np.concatenate([base[: rng.integers(50, 81)], rng.integers(1, 1 << 63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(rows)]


def joined(pairs) -> set:
    """The groups of ids that the pairs join."""
    part = {}
    for a, b in pairs:
        both = part.get(a, {a}) | part.get(b, {b})
        part.update(dict.fromkeys(both, frozenset(both)))
    return set(part.values())


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_tiles_go_on_in_the_next_frame(step):
    rng, rows, want = np.random.default_rng(8), [], []
    for leader, part, many in [(1, 0, 1), (100, 0, 2), (100, 1, 3), (200, 0, 40), (300, 0, 1), (400, 7, 9)]:
        sets = sets_of(rng, many)
        rows += [(leader, part, leader + part * 50 + i, len(s), pack.put_keys(s)) for i, s in enumerate(sets)]
        ids = [r[2] for r in rows[-many:]]
        want += [(ids[i], ids[j]) for i in range(many) for j in range(i) if jaccard.links(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))]
    # rows that repeat an id are one document
    rows.insert(4, rows[4])
    frame = pd.DataFrame(rows, columns=["leader", "part", "id", "n", "keys"])
    found = list(jaccard._tiles(frame.iloc[i : i + step] for i in range(0, len(frame), step)))
    assert len(want) > 100 and joined(pd.concat(found).itertuples(index=False, name=None)) == joined(want)
    assert not list(jaccard._tiles(iter([]))) and not len(pd.concat(jaccard._tiles(iter([frame[:1]]))))


def test_few_and_many_agree():
    rng = np.random.default_rng(9)
    for rows in (2, 3, 4, 30):
        sets = sorted(sets_of(rng, rows), key=len)
        n = np.array([len(s) for s in sets])
        assert (jaccard.similar_of_few(n, sets) == jaccard.similar_of_many(n, sets)).all()


def test_distinct():
    for x in ([], [5], [7, 7], [3, 1, 3, 2, 1]):
        x = np.array(x, np.uint64)
        assert jaccard.distinct(x).tolist() == np.unique(x).tolist() and jaccard.distinct(x).dtype == np.uint64
