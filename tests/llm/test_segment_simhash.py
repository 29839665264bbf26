"""Operator 12 against brute force over all pairs of fingerprints."""
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from spendledger.llm import queries
from spendledger.llm import segment_simhash as ss

SF = "/root/testdata/sf0.001"


def plain_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(prints, radius=4):
    """``prints``: (id, fingerprint) pairs; the smallest id reachable of each id."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, f) in enumerate(prints):
        for j, g in prints[:n]:
            if (f ^ g).bit_count() <= radius:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def brute(rows, radius=4):
    prints = [(i, plain_print(t)) for i, t in rows]
    to = joined([x for x in prints if x[0] is not None], radius)
    return Counter((i, f"{f:016x}", to.get(i), i is None or to[i] == i) for i, f in prints)


def test_points_bound_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 64, 2000, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 9, replace=False)) for k in range(2000)], np.uint64)
    b = a ^ flips
    counts = lambda f: np.array([[int(x) >> s & 1 for s in range(64)] for x in f]).reshape(len(f), 32, 2).sum(axis=2)
    want = np.abs(counts(a) - counts(b)).sum(axis=1)
    assert (ss.manhattan(ss.segment_counts(a), ss.segment_counts(b)) == want).all() and (want <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize(("radius", "groups"), [(4, 6), (4, 8), (3, 5), (1, 3)])
def test_every_pair_shares_a_grid_cell(radius, groups):
    rng = np.random.default_rng(radius)
    masks = ss.grids(groups, radius)
    for _ in range(500):
        f = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        g = f ^ sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        p, q = (int(x) for x in ss.segment_counts(np.array([f, g], np.uint64)))
        assert any(p & m == q & m for m in masks)
    assert [ss.groups_for(n, 4) for n in (0, 10**6, 10**8)] == sorted(ss.groups_for(n, 4) for n in (0, 10**6, 10**8))


@pytest.mark.parametrize("block", [2048, 5])
@pytest.mark.parametrize("groups", [6, 7])
def test_links_join_what_brute_force_joins(spark, block, groups):
    """Families around the radius, chains, one dense family far larger than a block."""
    rng = np.random.default_rng(8)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    prints = []
    for k in range(40):
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        prints += [x, *(flip(x, n) for n in (1, 4, 4, 5, 6, 8))]
        for _ in range(4):
            x = flip(x, 4)
            prints.append(x)
    hub = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    prints += [flip(hub, int(rng.integers(0, 4))) for _ in range(300)] + [0, (1 << 64) - 1, 1, 15, 31]
    prints = list(dict.fromkeys(prints))
    rows = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, vertex long").repartition(3)
    links = [tuple(r) for r in ss.near_links(df, 4, groups, block).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in links)
    near = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(a) == find(b) for a, b in near)
    if block > 1000:
        assert len(links) < len(near) / 4  # a forest for each cell, not all pairs


def test_op12_whole_table(spark, small):
    got = Counter(tuple(r) for r in queries.op12_segment_simhash(spark, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in small.collect()]) and not all(k[3] for k in got)


def test_prints_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one "), (6, "one two three"), (7, "ONE\ttwo three"), (8, "É b c d e"), (9, "é b c d e"),
            (None, "one"), (None, None), (10, "a b c d e f g"), (10, "a b c d e f g"), (11, "q r s t"), (11, "one"), (12, "word " * 60_000), (13, "Word " * 50_000),
            (14, " ".join(str(k) for k in range(100_000))), (15, "a\x85b c d e")]
    rows += [(20 + k, "the same long text of many words " * 3) for k in range(30)]
    got = Counter(tuple(r) for r in ss.near_duplicates(make(rows)).collect())
    assert got == brute(rows)
    assert ss.near_duplicates(make([])).count() == 0
    assert ss.near_duplicates(make([(5, None)])).collect()[0].asDict() == {"doc_id": 5, "fingerprint": "0" * 16, "component_id": 5, "kept": True}
