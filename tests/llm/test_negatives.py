"""Hard negatives with spanning-tree bounds against a brute-force version."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskpass.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank string"


def brute(rows, anchor, k=5, low=80, high=100, scale=256):
    rows = {(i, y, tuple(math.floor(scale * x) for x in v)) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, y, v in sorted(rows):
        if not anchor(a):
            continue
        scored = sorted((-dot(v, w), i, z) for i, z, w in rows if i != a)
        for s, p in [(-s, i) for s, i, z in scored if z == y][:k]:
            found = [(-t, i) for t, i, z in scored if z != y and low * s <= 100 * -t <= high * s][:k]
            out += [(a, p, r, i, s, t) for r, (t, i) in enumerate(found, 1)]
    return out


def clustered(rng, n, dims, spread=.05):
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, rng.choice([0, 0, 0, 1, 2, 3]), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for k in range(n)]


def odd_rows(rng):
    rows = clustered(rng, 240, 6)
    rows += [(1000 + k, k % 3, [0.5] * 6) for k in range(40)]  # ties
    rows += rows[:15] * 2                                       # repeated rows
    rows += [(2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [float("nan")]), (2040, 1, [float("inf")]),
             (None, 1, [1.0] * 6), (2050, 0, []), (2060, 1, [0.3]), (2070, 2, [0.1] * 9), (2080, 9, [1.0] * 6), (2090, 1, [-1.0] * 6)]
    return rows


@pytest.mark.parametrize("tree, block, cell, sub", [(128, 1 << 16, 128, 8192), (4, 50, 2, 16)])
def test_equals_brute_force(spark, monkeypatch, tree, block, cell, sub):
    for name, value in (("TREE", tree), ("BLOCK_ROWS", block), ("CELL_TREES", cell), ("SUB_ROWS", sub)):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives.plant, "__defaults__", (tree,))
    rows = odd_rows(random.Random(12))
    d = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in negatives.hard_negatives(d, F.col("id") % 10 == 0).collect())
    assert got == sorted(brute(rows, lambda i: i % 10 == 0)) and len(got) > 200


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, [rng.uniform(-1, 1) * 2 ** 20 for _ in range(4)]) for k in range(60)]  # sums beyond 2^53
    d = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in negatives.hard_negatives(d, F.col("id") % 10 == 0).collect())
    assert got == sorted(brute(rows, lambda i: i % 10 == 0)) and got


def test_no_rows(spark):
    d = spark.createDataFrame([(1, 1, [1.0], "")], SCHEMA)
    assert negatives.hard_negatives(d.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(d, F.col("id") % 10 == 0).count() == 0


def frames(rng, spread):
    rows = pd.DataFrame(clustered(rng, 3000, 24, spread), columns=["id", "label", "v"])
    rows["v"] = rows["v"].map(lambda v: np.floor(np.array(v) * 256))
    own = rows[:60]
    order, parent, edge = negatives.spanning_tree(negatives.matrix(own["v"]))
    node = np.argsort(order)
    tree = own.iloc[order].reset_index(drop=True).assign(
        tree=0, node=range(60), parent=[-1 if p < 0 else node[p] for p in parent[order]], edge=edge[order])
    return tree, rows


def test_bounds_hold_and_spare_scores():
    """In every tree scores lie inside their bounds; where anchors lie close, most rows need no score."""
    tree, rows = frames(random.Random(3), .02)
    block = negatives.Rows(rows, 24)
    x = negatives.matrix(tree["v"])
    seen = []

    def wanted(node, part, lo, hi):
        true = block.scores(part, x[node])
        assert (lo <= true).all() and (true <= hi).all()
        seen.append(node)
        mask = hi >= true.max()
        return mask, lambda places, scores: None

    scored = negatives.descend(tree, block, wanted)
    assert sorted(set(seen)) == list(range(60))
    assert scored < .6 * 60 * len(rows)


def test_tree_spans():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50):
        x = rng.integers(-3, 3, (n, 3)).astype(float)
        order, parent, edge = negatives.spanning_tree(x)
        assert sorted(order) == list(range(n)) and (parent < 0).sum() == 1
        place = np.argsort(order)
        assert all(p < 0 or place[p] < place[i] for i, p in enumerate(parent))
        assert all(p < 0 or math.isclose(edge[i], np.linalg.norm(x[i] - x[p])) for i, p in enumerate(parent))
