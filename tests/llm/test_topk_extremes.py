"""op6: components near the ends of a double's range."""

import math
import random

import numpy as np

from tidelog.llm import topk, vectors

MOST = 2**63 - 1


def test_extreme_components_are_exact_and_do_not_raise(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e306, -1.7e308, 7.1e305, 8e305, 0.0, 0.5, -0.25, 3e18, 1e-320]) for _ in range(4)]) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = {i: [math.floor(256 * int(x)) if abs(x) > 1e15 else math.floor(256 * x) for x in v] for i, v in rows}
    want = set()
    for q in (0, 50, 100):
        scored = sorted((-max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q)
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])}
    assert {tuple(r)[:4] for r in topk.op6_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()} == want


def test_quantized_is_plain_where_it_can_be():
    x = np.array([[0.1, -0.1, 1e300]])
    assert topk.quantized(x).dtype == np.float64 and (topk.quantized(x) == np.floor(256 * x)).all()
    assert topk.quantized(np.array([[1e308]])).dtype == np.longdouble


def test_a_kth_score_from_other_packs_spares_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    near = np.floor(rng.normal(size=(3000, 16)) * 200)
    far = np.floor(near * 0.2)
    ids = np.arange(6000)
    queries, q_ids = near[:40], ids[:40]
    scored = []
    inner = topk.inner
    monkeypatch.setattr(topk, "inner", lambda a, b: scored.append(len(a) * len(b)) or inner(a, b))
    first = topk.block_search(q_ids, queries, ids[:3000], near, 5)
    scored.clear()
    alone = topk.joined(first, topk.block_search(q_ids, queries, ids[3000:], far, 5), 5)
    before = sum(scored)
    scored.clear()
    carried = topk.joined(first, topk.block_search(q_ids, queries, ids[3000:], far, 5, floor=topk.kth(first)), 5)
    assert sum(scored) < before / 4
    scores = inner(queries, np.concatenate([near, far]))
    scores[np.arange(40), q_ids] = np.iinfo(np.int64).min
    order = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)[:, :5]
    for got in (alone, carried):
        assert (got[1] == ids[order]).all() and (got[0] == np.take_along_axis(scores, order, 1)).all()


def test_results_are_put_together_with_ties_repeats_and_gaps():
    def found(rows):
        return np.array([[s for s, _ in r] for r in rows]), np.ma.array([[max(i, -9) for _, i in r] for r in rows], mask=[[i == -99 for _, i in r] for r in rows])

    a, b = found([[(9, -5), (7, 4), (0, -99)], [(0, -99)] * 3]), found([[(9, -7), (7, 4), (7, 3)], [(2, 1), (0, -99), (0, -99)]])
    score, who = topk.joined(a, b, 3)
    assert who.tolist() == [[-7, -5, 3], [1, None, None]] and score[0].tolist() == [9, 9, 7] and score[1, 0] == 2
    assert topk.kth((score, who)).tolist() == [7, -np.inf]
