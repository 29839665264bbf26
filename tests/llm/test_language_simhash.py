"""Operators 6 and 10: held-out accuracy and brute force."""
import hashlib
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendledger.llm import hyper_language as hl
from spendledger.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def test_trigrams():
    keys, counts = hl.trigrams("Ab, ab!")
    assert {tuple(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)): n for k, n in zip(keys.tolist(), counts.tolist(), strict=True)} == {
        (" ", "a", "b"): 2, ("a", "b", " "): 2, ("b", " ", "a"): 1}
    assert len(hl.trigrams("12 34 …")[0]) == 0


def test_bundles_are_sums_of_bound_letters():
    b, (keys, counts) = hl.Binder(64), hl.trigrams("one two three two")
    want = sum(int(n) * np.roll(b.letter(k >> 42), 2) * np.roll(b.letter(k >> 21 & 0x1FFFFF), 1) * b.letter(k & 0x1FFFFF).astype(int)
               for k, n in zip(keys.tolist(), counts.tolist(), strict=True))
    assert np.allclose(b.bundle([(keys, counts)])[0], want) and set(np.unique(b.letter(97))) == {-1, 1}


def test_stretches_and_full_tables_change_nothing(monkeypatch):
    """Bundling in small stretches, with tables that are emptied again and again, gives the same vectors."""
    texts = [hl.trigrams(t) for t in ("one two three two", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d", "zwei drei one", "x" * 50)]
    whole = hl.Binder(64).bundle(texts)
    for name, value in (("STRETCH", 3), ("TRIGRAMS_KEPT", 5), ("LETTERS_KEPT", 4)):
        monkeypatch.setattr(hl, name, value)
    small = hl.Binder(64)
    assert (small.bundle(texts) == whole).all() and len(small.at) <= 5 and len(small.letters) <= 4


def test_memory_of_a_text_with_very_many_trigrams():
    """Trigrams of a million random letters of a large script, profiles of 60,000 at 4,096 dimensions, in a process of its own."""
    code = """
import resource, sys
import numpy as np
from spendledger.llm import hyper_language as hl
rng = np.random.default_rng(0)
far = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_000_000)))
p = hl.Profiles(["a", "b"], np.ones((2, 4096), np.float32) / 64)
p.predict(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
p.predict([far[:30_000], "plain text", far[30_000:60_000]])
far_grams = hl.trigrams(far)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(far_grams[0]))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) < 500 and int(out[1]) > 900_000


def brute_profiles(rows, dimensions):
    """Prototypes and choices recomputed from the definition, a trigram at a time."""
    b = hl.Binder(dimensions)
    bound = {}

    def vector(text, unit):
        keys, counts = hl.trigrams(text)
        out = np.zeros(dimensions, np.int64)
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            if k not in bound:
                bound[k] = b.bind(k).astype(np.int64)
            out += bound[k] * (n * hl.UNIT // int(counts.sum()) if unit else n)
        return out

    totals = {}
    for _, text, lang in rows:
        if text and lang and len(hl.trigrams(text)[0]):
            totals[lang] = totals.get(lang, 0) + vector(text, True)
    protos = {k: v / np.linalg.norm(v) for k, v in totals.items()}

    def choose(text):
        if not text or not len(hl.trigrams(text)[0]):
            return "und", 0.0
        v = vector(text, False) / max(1e-9, np.linalg.norm(vector(text, False)))
        return max(((k, float(v @ p)) for k, p in sorted(protos.items())), key=lambda x: x[1])

    return protos, choose


def test_profiles_and_choices_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(hl, "COUNTED", 700)
    rows = [(r.doc_id, (r.text or "")[:1500], r.lang) for r in small.limit(120).collect()] + [(-1, None, "en"), (-2, "12 3", "de"), (-3, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = hl.learn(docs, dimensions=256)
    protos, choose = brute_profiles(rows, 256)
    assert model.languages == sorted(protos) and np.allclose(model.prototypes, [protos[k] for k in model.languages], atol=1e-5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in hl.identify(docs, model).collect()}
    for i, text, _ in rows:
        lang, score = choose(text)
        assert got[i][0] == lang and abs(got[i][1] - max(0.0, score)) < 1e-4


def test_op6_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_hyper_language(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1
    judged = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(judged) > 200 and np.mean(judged) > 0.97


def test_language_odd_rows(spark, make):
    rows = [(k, "the cat and the dog of the house with " * 3, "en") for k in range(8)] + [(k, "der hund und die katze mit dem haus " * 3, "de") for k in range(20, 28)]
    rows += [(40, None, "en"), (41, "", "de"), (42, "12 34 ++", "en"), (43, "the house", None), (43, "the house", None), (None, "und die", None), (44, "the " * 40_000, None)]
    docs = make(rows)
    model = hl.learn(docs)
    got = Counter((r.doc_id, r.lang_pred, r.held_out) for r in hl.identify(docs, model).collect())
    assert sum(got.values()) == len(rows) and got[43, "en", zlib.crc32(b"43") % 4 == 2] == 2 and got[None, "de", False] == 1
    assert all(next(k[1] for k in got if k[0] == i) == "und" for i in (40, 41, 42))
    assert {r.doc_id for r in hl.keep_known(docs, model, 0.0).collect()} == {r[0] for r in rows} - {40, 41, 42}
    nothing = hl.learn(make([]))
    assert nothing.languages == [] and {r.lang_pred for r in hl.identify(docs, nothing).collect()} == {"und"}
    assert hl.identify(make([]), model).count() == 0


def brute_prints(spark, rows, radius=3):
    """The definition, term by term; the term hash alone comes from Spark."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    rows = [(i, t or "") for i, t in rows]
    made = []
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        made.append((i, t, t[:len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]))
    pairs = set()

    def terms(t):
        w = re.split(r"[\x20\x09-\x0D]+", t.strip(" \t\n\r\x0b\x0c"))
        return list(zip(w, [*w[1:], None], strict=True))

    for _, t, e in made:
        pairs |= set(terms(t)) | set(terms(e))
    df = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    hashes = {(r.a, r.b): r.h & (1 << 64) - 1 for r in df.collect()}

    def fp(t):
        v = [hashes[x] for x in terms(t)]
        return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in v) > len(v))

    prints = [(fp(t), fp(e)) for _, t, e in made]
    out = Counter()
    for k, (i, t, e) in enumerate(made):
        f, g = prints[k]
        near = sum((f ^ x).bit_count() <= radius for x, _ in prints) if i is not None and i % 20 == 0 else None
        out[i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{f:016x}", f"{g:016x}",
            1 - (f ^ g).bit_count() / 64, 1 - (f ^ prints[(k + 1) % len(made)][0]).bit_count() / 64, near] += 1
    return out


def test_op10_whole_table(spark, small):
    got = Counter(tuple(r) for r in queries.op10_simhash(spark, SF).collect())
    assert got == brute_prints(spark, [(r.doc_id, r.text) for r in small.collect()])
    assert np.mean([k[5] for k in got]) > np.mean([k[6] for k in got]) + 0.15


@pytest.mark.parametrize("rows_per_bucket", [2048, 3])
def test_prints_odd_rows(spark, make, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows_per_bucket)
    rows = [(k * 10, f"some words {k} of a text é{k} 🙂 end") for k in range(15)]
    rows += [(7, None), (8, ""), (9, " \n\t"), (20, "one"), (20, "one"), (20, "two words"), (None, "no id here"), (33, "long word " * 9000)]
    assert Counter(tuple(r) for r in simhash.fingerprint_report(make(rows)).collect()) == brute_prints(spark, rows)
    assert Counter(tuple(r) for r in simhash.fingerprint_report(make(rows[3:4])).collect()) == brute_prints(spark, rows[3:4])
    assert simhash.fingerprint_report(make([])).count() == 0


@pytest.mark.parametrize(("radius", "blocks"), [(3, 5), (2, 4), (4, 6), (3, None)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    for x in base[:20]:
        for flips in (1, radius, radius + 1):
            m = 0
            for b in rng.choice(64, flips, replace=False):
                m |= 1 << int(b)
            base.append(((x ^ m) + (1 << 63)) % (1 << 64) - (1 << 63))
    base += base[:5]
    df = spark.createDataFrame([(x,) for x in base] + [(None,)], "fp long")
    got = {(r.fp, r.near_fp): (r.distance, r.copies) for r in simhash.near(df, df, radius, blocks).collect()}
    n = Counter(base)
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b): (apart(a, b), n[b]) for a in n for b in n if apart(a, b) <= radius}
