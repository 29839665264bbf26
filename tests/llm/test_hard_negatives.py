"""Operator 13 against SQL and brute force; the tree's bounds against plain distances."""
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendledger.llm import hard_negatives as hn
from spendledger.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows, anchors=lambda i: i % 100 == 0, positives=5, negatives=10):
    """``rows``: (id, label, vector of whole numbers), as the definition says."""
    dims = max((len(v) for _, _, v in rows), default=0)
    full = [(i, x, [*v, *[0] * (dims - len(v))]) for i, x, v in rows]
    out = Counter()
    for n, (i, label, v) in enumerate(full):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, y) for m, (j, y, w) in enumerate(full) if m != n)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            bad = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out.update((i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(bad))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<int>").repartition(3)
    return Counter(tuple(r)[:6] for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_sql(spark):
    assert difference(spark, connect(SF), queries.QUERIES["op13_hyperplane_negatives"], queries.ORACLES["op13_hyperplane_negatives"], SF) is None


@pytest.fixture(scope="module")
def clusters():
    """Rows around a few centres, one of them holding a third, with equal vectors, ties and negative scores."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-90, 90, (9, 12))
    which = np.where(rng.random(1500) < 0.34, 0, rng.integers(0, 9, 1500))
    vectors = centres[which] + rng.integers(-12, 13, (1500, 12))
    vectors[rng.choice(1500, 60)] = centres[0]
    labels = np.where(rng.random(1500) < 0.3, rng.integers(0, 4, 1500), which % 4)
    return [(int(k), int(x), v.tolist()) for k, (x, v) in enumerate(zip(labels, vectors, strict=True))]


@pytest.mark.parametrize(("chunk", "block", "leaf"), [(2048, 1024, 512), (64, 4, 20), (100, 1024, 3)])
def test_clusters(spark, clusters, monkeypatch, chunk, block, leaf):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("LEAF_ROWS", leaf), ("CELLS", 5000), ("SPAN", 3)):
        monkeypatch.setattr(hn, name, value)
    assert run(spark, clusters) == brute(clusters)


@pytest.mark.parametrize("spread", [3, 40])
def test_subtrees_left_out_hold_nothing(spread):
    """Every row in a window lies in a leaf that is reached, and clustered rows leave most leaves out."""
    rng = np.random.default_rng(spread)
    rows = (rng.integers(-200, 200, (30, 16))[rng.integers(0, 30, 4000)] + rng.integers(-spread, spread + 1, (4000, 16))).astype(np.int32)
    square = (rows.astype(np.int64) ** 2).sum(axis=1)
    tree = hn.Tree(rows[:600], float(square.max()), 2)
    found = {}

    def seen(number, apart, nearest):
        node = tree.nodes[number]
        for j in np.unique(nearest):
            node.low[:, j] = np.minimum(node.low[:, j], apart[nearest == j].min(axis=0))
            node.high[:, j] = np.maximum(node.high[:, j], apart[nearest == j].max(axis=0))
        found[number] = True

    leaf = np.concatenate([tree.place(rows[k:k + 1000], seen) for k in range(0, 4000, 1000)])
    anchors = rows[:50]
    score = anchors.astype(np.int64) @ rows.T.astype(np.int64)
    best = np.sort(score, axis=1)[:, -20:]
    low, high = np.stack([best[:, 0], best[:, 0] // 2], axis=1), np.stack([best[:, -1], best[:, 0] * 6 // 10], axis=1)
    reached = tree.reached(anchors, low, high)
    for a in range(50):
        for w in range(2):
            inside = (score[a] >= low[a, w]) & (score[a] <= high[a, w])
            assert reached[a, leaf[inside]].all()
    if spread == 3:
        assert tree.reached(anchors, low[:, :1], high[:, :1])[:, np.unique(leaf)].mean() < 0.3


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, 0.25, -0.125], [0.5, 0.25], [], [0.0] * 3, [1.0, 0.5, 0.25], [-0.5, -0.25, 0.125], [0.001, -0.001, 0.0]]
    rows = [(k, k % 3, vectors[k % 7]) for k in range(220)] + [(100, 1, vectors[0]), (100, 1, vectors[0]), (200, 2, vectors[4]), (-100, 0, vectors[0]), (5, 1, vectors[4])]
    bad = [(300, None, vectors[0]), (400, 1, None), (500, 1, [0.1, None]), (600, 1, [nan, 1.0]), (700, 1, [inf]), (800, 2, [1e30, 0.0]), (None, 1, vectors[0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, label int, embedding array<float>, chunk string, row_no int").repartition(2)
    made = hn.quantised(df)
    want = [(i, x, [int(np.floor(256 * c)) for c in v]) for i, x, v in rows]
    assert Counter((r.vec_id, r.label, tuple(r.vector)) for r in made.collect()) == Counter((i, x, tuple(v)) for i, x, v in want)
    got = Counter(tuple(r)[:6] for r in hn.hard_negatives(made, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(want)
    assert run(spark, []) == Counter() and run(spark, [(0, 1, [1])]) == Counter() and run(spark, [(1, 1, [1]), (2, 1, [1])]) == Counter()
