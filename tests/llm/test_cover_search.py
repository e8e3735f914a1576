import math
import random

import numpy as np
import pytest

from folioframe.llm import cover_search as cs
from folioframe.llm.queries import op13_exact_topk_search

COLUMNS = ["query_id", "rank", "vec_id", "score"]


def plain(rows, k=5, every=50):
    """All products of all usable vectors in Python's whole numbers."""
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = {}
    for q, a in good:
        if q % every:
            continue
        best = out.setdefault(q, {})
        for i, b in good:
            if i != q:
                score = max(-cs.LONG, min(cs.LONG, sum(x * y for x, y in zip(a, b))))
                best[i] = max(score, best.get(i, -cs.LONG))
    return {(q, r, i, s) for q, best in out.items() for r, (s, i) in enumerate(sorted(((-s, i) for i, s in best.items()))[:k], 1) for s in [-s]}


def got(df):
    assert df.columns == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert got(op13_exact_topk_search(spark, path)) == plain(rows)


@pytest.mark.parametrize("block, turn", [(40, 256), (150, 1), (8192, 256)])
def test_odd_vectors(spark, monkeypatch, block, turn):
    """Small blocks and turns change nothing; a third of the rows is one vector."""
    monkeypatch.setattr(cs, "BLOCK_ROWS", block)
    monkeypatch.setattr(cs, "TURN_GROUPS", turn)
    monkeypatch.setattr(cs, "LEAF_ROWS", 8)
    monkeypatch.setattr(cs, "FANOUT", 4)
    rng = random.Random(11)
    spots = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(spots)]) for i in range(300)]
    rows += [(i, list(spots[0])) for i in range(300, 460)]
    rows += [(100, list(spots[1])), (100, list(spots[2])), (7, list(spots[3])), (7, list(spots[3])), (None, spots[0])]
    rows += [(900, None), (901, [None] * 6), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [0.0] * 6), (905, [1e308] * 6), (906, []), (950, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, rank int")
    rows = [r for r in rows if r[1] is None or len(r[1]) == 6]
    assert got(cs.top_products(df.where("vec_id % 50 = 0"), df)) == plain(rows)


def test_large_numbers_are_exact(spark):
    """Sums beyond 2^53, and scores beyond a long."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-(2**40), 2**40)) for _ in range(3)]) for i in range(80)]
    rows += [(i, [1e200 * rng.choice([-1, 1]), 1.0, 3.0]) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(cs.top_products(df.where("vec_id % 50 = 0"), df)) == plain(rows)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert got(cs.top_products(few.where("vec_id = 0"), few)) == {(0, 1, 1, 256 * 512)}
    assert got(cs.top_products(few.limit(0), few)) == set()
    assert got(cs.top_products(few, few.limit(0))) == set()


def test_groups_of_rows_far_away_are_pruned():
    """The trees save nearly all products where vectors lie in tight groups."""
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(40, 16)) * 1000
    rows = np.floor(spots[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)))
    tree = cs.cover_tree(rows)
    rows, ids = rows[tree.order], tree.order.astype(np.int64)
    assert sorted(tree.order) == list(range(4000))
    for n in range(len(tree.lo)):
        own = rows[tree.lo[n] : tree.hi[n]]
        assert np.sqrt(((own - tree.centre[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-6
    ask = rows[::50].copy()
    qtree = cs.cover_tree(ask)
    best = cs.Best(ids[::50][qtree.order], 5)
    done = cs.dual_search(ask[qtree.order], qtree, rows, ids, tree, best)
    assert done < len(ask) * len(rows) / 4
    full = ask[qtree.order] @ rows.T
    for q, found in enumerate(best.found):
        order = [i for i in np.lexsort((ids, -full[q])) if ids[i] != best.ids[q]][:5]
        assert [(-s, i) for s, i in found] == [(int(full[q, i]), int(ids[i])) for i in order]
