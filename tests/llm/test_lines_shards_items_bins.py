"""Operators 4, 5, 7 and 9 against brute force."""
import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from spendledger.llm import bin_packing, contamination, line_dedup, permuted_shards, queries
from spendledger.llm.common import WHITE

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = line_dedup.line_key(line)
            if k is not None and i is not None:
                holders[k].add(i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := line_dedup.line_key(x)) is None or i is None or min(holders[k]) >= i]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def test_line_key():
    assert line_dedup.line_key(" \tABCDEFGHIJ\r\x0b") == b"abcdefghij" and line_dedup.line_key("  ABCDEFGHI  ") is None
    assert line_dedup.line_key("Ééééééééé é") == "Ééééééééé é".encode() and WHITE == " \t\n\r\x0b\x0c"


def test_op4_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = {tuple(r) for r in queries.op4_line_dedup(spark, SF).collect()}
    assert got == set(con.execute(queries.ORACLES["op4_line_dedup"]).fetchall()) and any(r[2] for r in got)


@pytest.mark.parametrize("bits", [20, 28])
def test_lines_odd_rows(spark, make, bits):
    line, other = "the quick brown fox", "another line of text"
    rows = [(5, f"{line}\n{line}\nshort\n"), (3, f" {line.upper()}\t\nshort"), (9, None), (10, ""), (11, "\n\n"), (4, f"{other}\r\n{line}"),
            (7, other), (7, other), (None, line), (12, "x" * 50_000 + "\n" + other), (13, "x" * 50_000), (2, f"{line}\n{line}")]
    rows += [(100 + k, f"{line}\nunique line number {k}") for k in range(60)]
    got = Counter(tuple(r) for r in line_dedup.dedup_lines(make(rows, 7), bits=bits).collect())
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(make([]), bits=bits).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 4097])
def test_permutation(n):
    p, x = permuted_shards.Permutation(n, 7), np.arange(n)
    y = p.permute(x)
    assert sorted(y) == list(x) and (p.inverse(y) == x).all()
    assert n < 100 or ((y == x).mean() < 0.05 and (y != permuted_shards.Permutation(n, 8).permute(x)).any())


def check_shards(got, want, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert not got or max(map(len, by.values())) - (min(map(len, by.values())) if len(by) == shards else 0) <= 1


def test_op5_whole_table(spark, small):
    rows = small.collect()
    want = Counter((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in rows)
    first = queries.op5_permuted_shards(spark, SF).collect()
    check_shards(first, want, 16)
    # The place follows from the row number alone: another partitioning gives the same, and so does the arithmetic.
    again = permuted_shards.shard_documents(small.repartition(7), 16).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in first} == {r.doc_id: (r.shard, r.slot) for r in again}
    at = permuted_shards.Permutation(len(rows), 20_240_501).permute(np.arange(len(rows)))
    assert {r.doc_id: r.slot * 16 + r.shard for r in first} == dict(zip(sorted(r.doc_id for r in rows), at.tolist(), strict=True))


def test_shards_odd_rows(spark, make):
    rows = [(3, "é"), (3, "é"), (None, None), (1, ""), (2, "x" * 100_000)]
    check_shards(permuted_shards.shard_documents(make(rows), 16).collect(),
                 Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), 16)
    assert permuted_shards.shard_documents(make([]), 16).count() == 0


def brute_items(docs, items):
    """Every item against every window of its size: the best weighted share of shingles."""
    out = {}
    for i, text in docs:
        words = contamination.plain_words(text or "")
        for k, passage in items:
            want = contamination.plain_words(passage or "")
            width, best = min(5, len(want)), 0.0
            if not want or not words:
                continue
            need = Counter(tuple(want[a:a + width]) for a in range(len(want) - width + 1))
            weight = {s: sum(map(len, s)) for s in need}
            for start in range(max(1, len(words) - len(want) + 1)):
                w = words[start:start + len(want)]
                have = Counter(tuple(w[a:a + width]) for a in range(len(w) - width + 1))
                best = max(best, sum(min(n, have[s]) * weight[s] for s, n in need.items()) / sum(n * weight[s] for s, n in need.items()))
            if best >= contamination.SIMILARITY:
                out[i, k] = round(best, 9)
    return out


def test_op7_whole_table_and_edits(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.op7_contamination(spark, SF).collect()}
    have = {i: " ".join(map(bytes.decode, contamination.plain_words(t))) for i, t in items}
    text = {r.doc_id: " ".join(map(bytes.decode, contamination.plain_words(r.text))) for r in small.collect()}
    assert {(d, i) for d, t in text.items() for i, p in have.items() if f" {p} " in f" {t} "} == set(got) and got
    some = [(r.doc_id, r.text) for r in small.limit(12).collect()]
    assert brute_items(some, items[:8]) == {k: v for k, v in got.items() if k[0] in dict(some) and k[1] in dict(items[:8])}


def test_items_odd_rows(spark, make):
    item = " ".join(f"word{k}" for k in range(40))
    edited = item.replace("word20", "changed").upper()
    items = [(1, item), (2, "tiny one"), (3, None), (4, ""), (5, item), (None, item), (6, "...")]
    docs = [(1, f"before {edited}, after"), (2, None), (3, ""), (4, "a tiny one here"), (5, item), (5, item), (None, item),
            (6, " ".join(item.split()[:36])), (7, " ".join(item.split()[:25]) + " other words" * 9), (8, "filler " * 30_000 + item)]
    bench = make(items).withColumnRenamed("doc_id", "item_id")
    rows = contamination.find_passages(make(docs), bench).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    assert got == brute_items(docs, [x for x in items if x[0] is not None]) and (1, 1) in got and (6, 1) in got and (7, 1) not in got
    assert sum(r.doc_id == 5 for r in rows) == 4
    assert {r.doc_id for r in contamination.remove_contaminated(make(docs), bench).collect()} == {2, 3, 7}
    empty = make([]).withColumnRenamed("doc_id", "item_id")
    assert contamination.find_passages(make(docs), empty).count() == 0 and contamination.find_passages(make([]), bench).count() == 0
    assert contamination.remove_contaminated(make(docs), empty).columns == make(docs).columns


def check_bins(rows, lengths, capacities):
    bins = defaultdict(list)
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
        if r.length:
            bins[r.bin_id, r.capacity].append((r.bin_offset, r.length))
        else:
            assert r.bin_id is None and r.capacity is None
    assert total == Counter(lengths) and len({b for b, _ in bins}) == len(bins)
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert capacity == min(c for c in capacities if c >= at)


def test_op9_whole_table(spark, small):
    rows = queries.op9_bin_packing(spark, SF).collect()
    want = Counter()
    for r in small.collect():
        want[r.doc_id] = len(r.text.encode()) + 1
    check_bins(rows, want, bin_packing.CAPACITIES)
    final = {r.bin_id: r.capacity for r in rows}
    assert sum(want.values()) / sum(final.values()) > 0.95


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(5)
    lengths = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    where, used = bin_packing.best_fit(lengths, (100,), lambda _: 100)
    room, want = [], []
    for x in lengths:
        fits = [r for r in room if r >= x]
        want.append(min(fits) if fits else 100)
        if fits:
            room.remove(min(fits))
        room.append(want[-1] - x)
    got, left = [], defaultdict(lambda: 100)
    for x, b in zip(lengths, where.tolist(), strict=True):
        got.append(left[b])
        left[b] -= x
    assert got == want and max(used) <= 100


def test_bins_odd_rows(spark, make):
    df = make([(k, "t") for k in range(50)] + [(7, "t"), (None, None)])
    lengths = {k: (k * 37) % 90 for k in range(50)} | {None: 0}
    table = df.select("doc_id", "text", "kept").toPandas()
    table["n_tokens"] = [lengths[None if i != i else int(i)] for i in table.doc_id]
    sized = spark.createDataFrame([(None if i != i else int(i), None if n == 0 else int(n)) for i, n in zip(table.doc_id, table.n_tokens, strict=True)],
                                  "doc_id long, n_tokens long")
    rows = bin_packing.pack(sized, capacities=(16, 40), group=20).collect()
    check_bins(rows, lengths | {7: 2 * lengths[7]}, (16, 40))
    assert bin_packing.pack(sized.limit(0)).count() == 0


def plain_packing(lengths, capacities, cost):
    """Cost and bins of the cheapest of all ways to open bins, each packed from plain lists."""
    by_unit = lambda x: min((c for c in sorted(capacities) if c >= x), key=lambda c: cost(c) / c)
    ways = [by_unit, *(lambda x, w=w: max(w, min(c for c in capacities if c >= x)) for w in sorted(capacities))]
    found = []
    for opens in ways:
        bins = []
        for x in lengths:
            open_ = [b for b in bins if b["room"] >= x]
            if open_:
                least = min(b["room"] for b in open_)
                bin_ = [b for b in open_ if b["room"] == least][-1]
            else:
                bins.append(bin_ := {"room": opens(x), "used": 0})
            bin_["room"] -= x
            bin_["used"] += x
        final = sorted(min(c for c in capacities if c >= b["used"]) for b in bins)
        found.append((sum(map(cost, final)), final))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_packing_against_all_ways(seed):
    """The group's final lengths cost what the cheapest way costs; no way is cheapest for all inputs."""
    rng = np.random.default_rng(seed)
    capacities, cost = (16, 32, 64, 128), lambda c: 9 + c + c * c / 150
    lengths = sorted(rng.integers(1, (20, 128, 40, 128, 9, 65)[seed], 150).tolist(), reverse=True)
    where, final = bin_packing.pack_group(lengths, capacities, cost)
    ways = plain_packing(lengths, capacities, cost)
    assert abs(sum(cost(int(c)) for c in final) - min(w[0] for w in ways)) < 1e-6
    used = np.bincount(where, lengths, len(final)).astype(int)
    assert all(u <= c and not any(u <= d < c for d in capacities) for u, c in zip(used.tolist(), final.tolist(), strict=True))
    assert len({round(w[0], 6) for w in ways}) > 1


def partial_copies(rng, items):
    """Documents with a cut copy or a replaced clause of an item, shares on both sides of the threshold."""
    docs = []
    for passage in items:
        words = passage.split()
        for _ in range(6):
            n = max(1, round(len(words) * rng.uniform(0.78, 0.9)))
            cut = int(rng.integers(0, len(words) - n + 1))
            a = int(rng.integers(0, len(words)))
            b = a + max(1, round(len(words) * rng.uniform(0.02, 0.15)))
            clause = words[:a] + [f"new{rng.integers(10**6)}" for _ in words[a:b]] + words[b:]
            for core in (words[cut:cut + n], clause):
                docs.append(" ".join([f"pre{k}" for k in rng.integers(0, 10**6, 30)] + core + [f"post{k}" for k in rng.integers(0, 10**6, 30)]))
    return docs


def test_partial_copies_are_all_found(spark, make):
    """Windows at the threshold are found whatever share of their single words differs, in items that share a template too."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"{'abcdefghijklmnop'[:k % 16 + 1]}{k}" for k in rng.integers(0, 4000, n)]
    template = word(25)
    items = [(k, " ".join(word(n))) for k, n in enumerate((20, 40, 59, 100, 200))]
    items += [(10 + k, " ".join(template + word(35))) for k in range(4)] + [(20, " ".join(["again", "and", "more"] * 9 + word(9)))]
    docs = list(enumerate(partial_copies(rng, [t for _, t in items])))
    got = contamination.find_passages(make(docs), make(items).withColumnRenamed("doc_id", "item_id")).collect()
    want = brute_items(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert sum(s < 0.85 for s in want.values()) >= 20 and len({d for d, _ in want}) < len(docs)
