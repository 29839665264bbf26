"""The step that all ledger queries share: quick probes read as the full expressions do, nothing is copied, sorted or stored needlessly."""
import re
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as contract  # noqa: E402
from spendledger.functions import text as T  # noqa: E402
from spendledger.functions.amounts import compact  # noqa: E402
from spendledger.functions.dates import day_part, parse_format  # noqa: E402
from spendledger.operators.quality import id_collisions  # noqa: E402
from spendledger.session import compiled  # noqa: E402
from spendledger.workload import feeds  # noqa: E402

SF = "/root/testdata/sf0.001"
TEXTS = ["a b", "a  b", " a", "a ", "a\n", "a\nb", "a\tb", " a", "a b", "été", "", " ", None, "A\x1cB", "ABC def", "a\x85"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_probes_change_no_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    plain = F.nullif(F.trim(F.regexp_replace(t, rf"{T._BLANK}+", " ")), F.lit(""))
    for new, old in ((T.normalise_text(t), plain), (day_part(t), F.substring_index(T.strip(t), "T", 1)),
                     (T.found_in(t, r"\bb\b|é|c\s", "i"), t.rlike("(?iU)\\bb\\b|é|c\\s"))):
        assert [r for r in df.select(new.alias("x")).collect()] == [r for r in df.select(old.alias("x")).collect()]
    assert [r[0] for r in df.select(T.fold(t)).collect()][-2:] == ["abc def", "a"]


def test_classes_that_differ_on_ascii_keep_the_unicode_reading(spark):
    df = spark.createDataFrame([("a+b",), ("a!b",)], "t string")
    assert [r[0] for r in df.select(T.found_in(F.col("t"), r"\p{Punct}", "i")).collect()] == [False, True]


def test_plain_amounts_need_no_cleaning(spark):
    df = spark.createDataFrame([("-1,234.50",), ('"1 200"',), ("12 f cfa",), ("7.-",)], "t string")
    assert [r[0] for r in df.select(compact(F.col("t"), ("F CFA",))).collect()] == ["-1,234.50", "1200", "12", "7.-"]
    assert [r[0] for r in df.select(compact(F.col("t"), (".-",))).collect()][3] == "7"


@pytest.mark.parametrize("fmt, values", [
    ("%d/%m/%Y", {"1/2/1999": date(1999, 2, 1), "31/02/1999": None, "01/02/0000": None, "1999-02-01": None, "01/02/1999\n": None}),
    ("%Y-%m-%d", {"1999-2-1": date(1999, 2, 1), "1999-13-01": None, "99-01-01": None}),
    ("%d.%m.%Y", {"29.02.2000": date(2000, 2, 29), "29x02x2000": None}),
    ("%Y%m%d", {"19990201": date(1999, 2, 1)}),
])
def test_numeric_dates_without_a_formatter(spark, fmt, values):
    df = spark.createDataFrame([(k,) for k in values], "t string")
    assert [r[0] for r in df.select(parse_format(F.col("t"), fmt)).collect()] == list(values.values())


def test_repeated_ids_are_joined_once(spark):
    rows = spark.createDataFrame([("C", "x", n) for n in range(40)] + [("C", "y", 1), ("D", "x", 1), ("C", None, 1), ("C", None, 2), ("C", "", 1), ("C", "", 2)],
                                 "country string, id string, at int")
    found = id_collisions(rows, ["country", "id"], ["at"])
    assert sorted((r["id"], r["at"], r["first_position"]["at"], r["occurrences"]) for r in found.collect()) == [("x", n, 0, 40) for n in range(1, 40)]
    assert "explode" not in _plan(found)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_lines_are_dealt_by_position_and_stay_compiled(spark):
    assert "RebalancePartitions [row_no" in _plan(feeds.lines(spark, SF))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "4000")
    assert compiled(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "4000"
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["dq_register_summary", "dq_drilldown", "dq_ranked", "dq_catalogue", "dq_severity", "load_report_issues"])
def test_register_stores_and_copies_nothing(spark, name):
    plan = _plan(contract.queries()[name](spark, SF))
    assert "Relation [l_orderkey" in plan and "_salt" not in plan


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_similar_texts_are_joined_before_results_are_spelled_out(spark):
    plan = _plan(contract.queries()["layered_classify"](spark, SF))
    assert "_map_sha#" in plan and not re.search(r"(?<!_)map_sha#", plan)
