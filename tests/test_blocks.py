"""Files cut into blocks of a few bytes give the records of the whole file."""
import csv
import io
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spendledger.config import SourceSpec
from spendledger.sources.blocks import Scanner, after, composed, json_elements, quoted_records
from spendledger.sources.delimited import read_delimited
from spendledger.sources.json_records import read_json_array


@pytest.fixture
def blocks(spark):
    """Sets the size of a block for the test."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def document(rng, n):
    """Records with brackets, quotes, escapes and line breaks in their texts, nested values and odd spacing."""
    texts = ['plain', 'a "quoted" one', "close } and ] here", "open { [ x", 'back\\slash\\', 'end\\"', "line\nbreak", "é🙂", "", "{}", "[,]", '"},{"']
    record = lambda k: {"id": k, "t": rng.choice(texts), "parts": [{"p": rng.choice(texts), "v": [1, [2, {"x": rng.choice(texts)}]]} for _ in range(rng.randint(0, 3))]}
    return [rng.choice([record(k), record(k), k, rng.choice(texts), None, [], {}, [rng.choice(texts)]]) for k in range(n)]


@pytest.mark.parametrize(("size", "keys"), [(150, ()), (61, ("body", "entries")), (400, ("rows",)), (1 << 20, ("rows",))])
def test_json_in_blocks(spark, tmp_path, blocks, size, keys):
    rng = random.Random(size)
    folder, want = tmp_path / "in", {}
    folder.mkdir()
    for k, n in enumerate((0, 1, 16)):
        records = document(rng, n)
        if keys == ():
            doc = records
        elif keys == ("rows",):
            doc = {"about": {"n": [1, 2], "rows": [9]}, "other": [[1], {"rows": [3]}], "rows": records, "more": [4, {"x": "}"}]}
        else:
            doc = {"about": {"n": [1, "}{"], "entries": [8]}, "body": {"other": [5, 6], "entries": records, "z": [7]}, "entries": [1]}
        (folder / f"{k}.json").write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), encoding="utf-8")
        want |= {(f"{k}.json", i + 1): x for i, x in enumerate(records)}
    (folder / "3.json").write_text('{"nothing": {"here": 1}}')
    blocks(size)
    got = json_elements(spark, str(folder), keys)
    found = {(r["source_file"].rpartition("/")[2], r["ordinal"]): json.loads(r["element"]) for r in got.collect()}
    assert found == want and got.count() == len(want)
    if size == 61:
        assert spark.read.option("lineSep", "}").text(str(folder)).select("_metadata.file_block_start").distinct().count() > 5


def test_effects_compose():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice('{}[],"\\ax') for _ in range(rng.randint(2, 30))).encode()
        cut = rng.randint(1, len(text) - 1)
        if text[cut - 1:cut] == b"\\":
            continue  # pieces end behind a bracket, so no escape is parted
        for inside in (False, True):
            whole, first = Scanner(text, inside), Scanner(text[:cut], inside)
            second = Scanner(text[cut:], first.inside_after)
            assert second.inside_after == whole.inside_after and composed(first.effect(), second.effect()) == whole.effect()
            assert after("{[{", whole.effect()) == after(after("{[{", first.effect()), second.effect())


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_quoted_line_breaks_in_blocks(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    texts = ["x", "two\nlines", 'say "hi"\n\n"again"', ",", "\n", "", "é\n🙂", 'a""b', "many\nmany\nmany\nlines " * 3]
    folder, want = tmp_path / "in", {}
    folder.mkdir()
    for k, n in enumerate((0, 1, 14)):
        rows = [[str(i), rng.choice(texts), rng.choice(texts), *(["more"] if rng.random() < 0.1 else [])] for i in range(n)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(["n", "a", "b"])
        for r in rows:
            writer.writerow(r)
            if rng.random() < 0.2:
                out.write("\n")
        (folder / f"{k}.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
        want |= {(f"{k}.csv", i + 2): (*r[:3], r[3:] or None) for i, r in enumerate(rows)}
    blocks(size)
    read = read_delimited(spark, str(folder), SourceSpec("C", multiline=True))
    got = {(r["source_file"].rpartition("/")[2], r["row_no"]): (r["n"], r["a"], r["b"], r["_extra"]) for r in read.collect()}
    assert got == want and read.count() == len(want)


def test_lines_are_read_once(spark, tmp_path):
    """No plan behind the one that lands the lines reads the source."""
    (tmp_path / "a.csv").write_text('n,t\n1,"x\ny"\n')
    assert {f.rpartition("/")[2][:5] for f in quoted_records(spark, str(tmp_path / "a.csv")).inputFiles()} == {"part-"}


def test_documents_of_the_old_reader(spark, tmp_path):
    """Numbers keep their digits and texts theirs."""
    (tmp_path / "d.json").write_text('﻿ [ {"a" : 1.50, "b":"1.50"} , 7,\n"x" ]\n', encoding="utf-8")
    rows = read_json_array(spark, str(tmp_path / "d.json"), SourceSpec("C", reader="json")).orderBy("row_no")
    assert [(r["row_no"], r["payload"]) for r in rows.collect()] == [(1, '{"a":1.5,"b":"1.50"}'), (2, "7"), (3, '"x"')]
    assert rows.where(F.col("payload").isNull()).count() == 0


SF = "/root/testdata/sf0.001"


def joins(spark, build):
    """The joins of a plan from the top, where the planner itself thinks no table small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return re.findall(r"(\w+Join)\b", build()._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set(key, old)


def files_written(spark, monkeypatch, name, per_file):
    """The answer of a query and its files, where a file may have few bytes."""
    import __spark_entry__ as contract
    from compare import connect, difference
    from spendledger.workload import ledger_queries

    monkeypatch.setattr(ledger_queries, "_FILE_BYTES", per_file, raising=False)
    made, path = [], ledger_queries.scratch_path
    monkeypatch.setattr(ledger_queries, "scratch_path", lambda s, n: made.append(path(s, n)) or made[-1])
    apart = difference(spark, connect(SF), contract.queries()[name], contract.oracle_sql()[name], SF)
    return apart, [f for d in made for f in Path(d).glob("part-*")]


def test_lines_meet_their_block_without_shuffle(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"x\ny"\n')
    assert joins(spark, lambda: quoted_records(spark, str(tmp_path / "a.csv")))[0] == "BroadcastHashJoin"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_csv_files_grow_in_number(spark, monkeypatch):
    """More text makes more files, not larger ones: each is written by one task."""
    apart, files = files_written(spark, monkeypatch, "csv_multiline_blocks", 50_000)
    assert apart is None and len(files) > 5 and max(f.stat().st_size for f in files) < 250_000


@pytest.mark.parametrize("keys", [(), ("rows",)])
def test_elements_meet_their_file_without_shuffle(spark, tmp_path, keys):
    (tmp_path / "a.json").write_text('{"rows": [1, 2]}' if keys else "[1, 2]")
    assert joins(spark, lambda: json_elements(spark, str(tmp_path / "a.json"), keys))[0] == "BroadcastHashJoin"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_json_files_grow_in_number(spark, monkeypatch):
    apart, files = files_written(spark, monkeypatch, "json_array_blocks", 10_000)
    assert apart is None and len(files) > 5 and max(f.stat().st_size for f in files) < 20_000
