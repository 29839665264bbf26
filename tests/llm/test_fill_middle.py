"""Operator 11: the boundary set against plain lists, the whole query against the definition."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from spendledger.llm import fill_middle as fm
from spendledger.llm import queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = Counter()
    for i, t in rows:
        t = t or ""
        u = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = sha(f"7:{'' if i is None else i}")
        h1, _, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(u) + 1), int(h[8:16], 16) % (len(u) + 1)))
        p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
        form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 100 else "spm" if h4 % 100 < 50 else "psm"
        o = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        cut = (None, None) if form == "plain" else (len(p), len(m))
        out[(i, len(u), form, *cut, sha(o), sha(t))] += 1
    return out


def query(docs):
    from pyspark.sql import functions as F

    made = fm.fill_in_middle(docs)
    return Counter(tuple(r) for r in made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256),
        F.sha2(F.encode(fm.restored(F.col("output"), F.col("form")), "UTF-8"), 256)).collect())


@pytest.mark.parametrize(("kind", "values"), [
    (fm.ArrayContainer, [3, 9, 65_535]), (fm.RunContainer, [*range(5, 900), *range(1000, 1010)]),
    (fm.BitmapContainer, list(range(0, 65_536, 2))), (fm.ArrayContainer, list(range(0, 8192, 2))), (fm.BitmapContainer, list(range(0, 8194, 2)))])
def test_containers_select(kind, values):
    made = fm.container(np.array(values))
    assert type(made) is kind and [made.select(k) for k in range(len(values))] == values


def test_boundaries_over_many_containers():
    rng = np.random.default_rng(1)
    sparse, dense = np.unique(rng.integers(1, 1 << 18, 900)), (1 << 19) + np.unique(rng.integers(0, 1 << 16, 40_000))
    runs = (1 << 20) + np.r_[np.arange(70_000), np.arange(70_010, 70_400)]
    ends = np.r_[sparse, dense, runs]
    made = fm.Boundaries(ends)
    assert {type(c) for c in made.containers} == {fm.ArrayContainer, fm.BitmapContainer, fm.RunContainer} and len(made) == len(ends)
    asked = {1, 2, len(sparse), len(sparse) + 1, len(ends) - 1, len(ends), *rng.integers(1, len(ends) + 1, 500).tolist()}
    assert made.cut(0) == 0 and all(made.cut(k) == ends[k - 1] for k in asked)


def test_op11_whole_table(spark, small):
    got = Counter(tuple(r) for r in queries.op11_boundary_fim(spark, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in small.collect()]) and {k[2] for k in got} >= {"psm", "spm"}
    assert all(k[5] == k[6] for k in got if k[2] == "plain")


def test_op11_sql(spark):
    from pathlib import Path
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from compare import connect, difference

    assert difference(spark, connect(SF), queries.QUERIES["op11_boundary_fim"], queries.ORACLES["op11_boundary_fim"], SF) is None


def test_fill_in_middle_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "one\ntwo\r\nthree\n"), (7, "has <P> in it\nand more"), (8, "<M>"), (9, "< P> <s>\n<p>"),
            (10, "é🙂\n日本\n" * 50), (11, "a b\x0bc\x85d"), (None, "no id\nhere\n"), (12, "same\nrow"), (12, "same\nrow"), (13, "\n" * 200_000), (14, "ab\n" * 60_000), (15, "x" * 300_000)]
    rows += [(k, f"line {k}\n" * (k % 7)) for k in range(100, 160)]
    assert query(make(rows)) == brute(rows)
    assert fm.fill_in_middle(make([])).count() == 0
    plain = fm.fill_in_middle(make(rows), rate=0).collect()
    assert {r.form for r in plain} == {"plain"} and Counter(r.output for r in plain) == Counter(t or "" for _, t in rows)
