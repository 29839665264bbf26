"""Operators 2 and 3 against brute force."""
import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from spendledger.llm import anchor_dedup, forest_dedup, queries
from spendledger.llm import components as component_module
from spendledger.llm.common import rolling, word_hashes, words_of
from spendledger.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_components(rows, size, percent):
    sets = defaultdict(set)
    shingle = []
    for i, t in rows:
        w = words_of(t or "", lower=True)
        k = min(size, len(w))
        s = frozenset(tuple(w[a:a + k]) for a in range(len(w) - k + 1)) if w else frozenset()
        shingle.append((i, s))
        if i is not None and s:
            sets[i].add(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return Counter((i, len(s), find(i) if s and i is not None else i, i is None or not s or find(i) == i) for i, s in shingle)


def edited(rng, words, share):
    w = list(words)
    for at in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[at] = f"new{rng.integers(10**6)}"
    return w


@pytest.fixture(scope="module")
def families():
    """Bases with copies of different likeness, around the threshold too, chains, and one large group of near copies."""
    rng, out = np.random.default_rng(3), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for share in (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08):
        base = list(rng.choice(vocabulary, 120))
        out += [base, *(edited(rng, base, share) for _ in range(5))]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 0.02)
            out.append(chain)
    big = list(rng.choice(vocabulary, 200))
    out += [edited(rng, big, 0.005 * int(rng.integers(1, 7))) for _ in range(120)] + [big] * 30
    order = rng.permutation(len(out))
    return [(int(k) * 3, " ".join(out[j])) for k, j in enumerate(order)]


@pytest.mark.parametrize(("size", "percent", "paired", "crowd", "block"), [(3, 85, 48, 4096, 512), (5, 80, 2, 4096, 7)])
def test_families(spark, make, families, monkeypatch, size, percent, paired, crowd, block):
    monkeypatch.setattr(forest_dedup, "BLOCK", block)
    got = forest_dedup.near_duplicates(make(families, 4), size, percent, paired, crowd)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(families, size, percent)


def test_crowded_regions_are_cut_deeper(spark, make, families):
    """Cuts at deeper prefixes decide nothing: every component is the brute-force one."""
    got = forest_dedup.near_duplicates(make(families, 4), 5, 80, paired=4, crowd=40)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(families, 5, 80)


def test_families_with_forced_crowding(spark, make, families):
    """A region above the crowd loses nothing: every component is the brute-force one."""
    got = forest_dedup.near_duplicates(make(families, 4), 3, 85, 4, 8)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(families, 3, 85)


def test_stragglers_beside_a_crowded_family(spark, make):
    """Documents linked to one member alone of a joined family that is larger than the crowd."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(240)]
    texts = [base] + [base[:k] + [f"one{k}"] + base[k + 1:] for k in rng.choice(240, 60, replace=False).tolist()]
    stragglers = [base[:a] + [f"new{a}x{k}" for k in range(22)] + base[a + 22:] for a in range(8, 208, 10)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts + stragglers)]
    got = forest_dedup.near_duplicates(make(rows, 4), 5, 80, paired=4, crowd=8)
    assert Counter(tuple(r) for r in got.collect()) == (want := brute_components(rows, 5, 80)) and {k[2] for k in want} == {0}


def test_op2_whole_table(spark, small):
    got = Counter(tuple(r) for r in queries.op2_forest_dedup(spark, SF).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in small.collect()], 3, 85) and not all(k[3] for k in got)


def test_forest_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one "), (6, "one two"), (7, "ONE\ttwo"), (8, "two one"), (None, "one"), (None, "a b c d"),
            (9, "a b c d"), (9, "a b c d"), (10, "É b c d"), (11, "é b c d"), (12, "x y z " * 30_000), (13, "x Y z " * 30_000), (14, "q r s t u"), (14, "a b c d")]
    got = Counter(tuple(r) for r in forest_dedup.near_duplicates(make(rows), 3, 85).collect())
    assert got == brute_components(rows, 3, 85)
    assert forest_dedup.near_duplicates(make([]), 3, 85).count() == 0
    assert forest_dedup.near_duplicates(make([(1, None)]), 3, 85).collect()[0].asDict() == {
        "doc_id": 1, "n_shingles": 0, "component_id": 1, "kept": True}


@pytest.mark.parametrize("cells", [1 << 24, 64])
def test_overlaps(monkeypatch, cells):
    monkeypatch.setattr(forest_dedup, "CELLS", cells)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(25)]
    got = forest_dedup.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(25) if i != j)


def test_components(spark):
    rng = np.random.default_rng(1)
    ids = rng.permutation(400).tolist()
    links = [*zip(ids[:99], ids[1:100], strict=True), *((ids[100], x) for x in ids[101:200]), *((x, ids[200]) for x in ids[201:210]), (ids[300], ids[300])]
    root = {}
    for part in (ids[:100], ids[100:200], ids[200:210]):
        root |= dict.fromkeys(part, min(part))
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["ascending", "descending", "random"])
def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch, order):
    rounds, n = [], 10_000
    plain = component_module.materialise
    monkeypatch.setattr(component_module, "materialise", lambda df, name: rounds.append(name) or plain(df, name))
    ids = {"ascending": range(n), "descending": range(n, 0, -1), "random": np.random.default_rng(5).permutation(n).tolist()}[order]
    links = [(ids[k], ids[k + 1]) for k in range(n - 1)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert got.select("component").distinct().collect() == [(min(ids),)] and got.count() == n
    assert rounds.count("parents") <= 20


def brute_passages(rows, width):
    first, out = {}, Counter()
    split = [(i, words_of(t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - width + 1) if i is not None else ():
            k = tuple(w[a:a + width])
            first[k] = min(first.get(k, i), i)
    for i, w in split:
        gone = set()
        for a in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[a:a + width])] < i:
                gone |= set(range(a, a + width))
        out[i, " ".join(x.decode() for k, x in enumerate(w) if k not in gone), len(w), len(gone)] += 1
    return out


def test_covers():
    for period, cover in anchor_dedup.COVERS.items():
        assert all(any((i + k) % period in cover and k % period in cover for k in range(period)) for i in range(period))
    h = word_hashes(words_of("a b c d e a b c d"))
    r = rolling(h, 4)
    assert r[0] == r[5] and len(set(r.tolist())) == 5 and len(rolling(h, 10)) == 0
    assert anchor_dedup.cover_for(50)[0] == 31 and anchor_dedup.cover_for(8)[0] == 3 and anchor_dedup.cover_for(2)[0] == 1


def test_op3_whole_table(spark, small):
    got = {tuple(r) for r in queries.op3_anchor_dedup(spark, SF).collect()}
    want = brute_passages([(r.doc_id, r.text) for r in small.collect()], 50)
    assert got == {(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, k, n, m in want} and any(r[2] for r in got)


@pytest.mark.parametrize("width", [50, 12, 3])
def test_passages_odd_rows(spark, make, width):
    rng = np.random.default_rng(width)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    shared, rows = word(60), []
    for k in range(40):  # passages of every length around the width, at every offset
        take = int(rng.integers(width - 2, width + 8))
        rows.append((k, " ".join([*word(int(rng.integers(0, 40))), *shared[:take], *word(5), *shared[60 - take:]])))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, " ".join(shared)), (103, " ".join(shared)), (104, " ".join(word(5) + shared)),
             (104, " ".join(word(9) + shared)), (None, " ".join(shared)), (105, "same " * 300), (106, "same " * 300), (107, " ".join(shared).upper()),
             (90, "\n".join(word(20_000) + shared))]
    assert Counter(tuple(r) for r in anchor_dedup.dedup_passages(make(rows, 5), width).collect()) == brute_passages(rows, width)
    assert anchor_dedup.dedup_passages(make([]), width).count() == 0
