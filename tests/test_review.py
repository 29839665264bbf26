"""Review decisions over current rows: one join, the same rows as the merged history, nothing copied or read twice."""
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as contract  # noqa: E402
from spendledger.operators.classify import RESULT_TYPE, classification_rows  # noqa: E402
from spendledger.operators.history import SCHEME_KEY, apply_decisions, current, merge_decisions, reviewed  # noqa: E402
from spendledger.plans.views import flatten_results, pivot_schemes  # noqa: E402
from spendledger.session import stored  # noqa: E402

SF = "/root/testdata/sf0.001"


def _classified(spark):
    results = [(None, "UNCLASSIFIED", "none", None, 0.0, True, "x"), ("HC.1", "CLASSIFIED", "keyword", "K", 0.7, True, "y"),
               ("HC.2", "CLASSIFIED", "account_mapping", "M", 0.9, False, "z")]
    rows = [("b", "C1", "f", "", k, 0, results[k % 3], results[(k + 1) % 3], [], "t") for k in range(12)]
    return spark.createDataFrame(rows, "batch_id string, country_code string, source_file string, source_sheet string, row_no long, "
                                       f"child_pos int, sha {RESULT_TYPE}, srhr {RESULT_TYPE}, guard_hits array<string>, text string")


def test_reviewed_is_the_merged_history(spark):
    rows = classification_rows(_classified(spark), datetime(2025, 1, 1))
    day = datetime(2025, 2, 1)
    decisions = spark.createDataFrame(
        [("b", "C1", "f", "", k, 0, s, a, c, "ann", "", day, n)
         for k in range(0, 12, 2) for s in ("SHA", "SRHR")
         for n, (a, c) in enumerate((("CORRECT", ""), ("ACCEPT", None), ("CORRECT", "HC.9"))[k // 2 % 2 * 2:], 1)],
        "batch_id string, country_code string, source_file string, source_sheet string, row_no long, child_pos int, scheme string, "
        "action string, new_code string, reviewed_by string, review_note string, decided_at timestamp, decision_no int")
    want = current(merge_decisions(rows, apply_decisions(rows, decisions)))
    got = reviewed(rows, decisions)
    assert sorted(got.columns) == sorted(want.columns)
    order = list(SCHEME_KEY)
    assert got.orderBy(*order).collect() == want.select(*got.columns).orderBy(*order).collect()
    assert {r["review_status"] for r in got.collect()} == {"ACCEPTED", "CORRECTED", "PENDING", "NOT_REQUIRED"}


def test_results_beside_the_record_are_the_pivoted_rows(spark):
    classified = _classified(spark)
    flat, wide = flatten_results(classified), pivot_schemes(current(classification_rows(classified)))
    assert sorted(flat.select(*wide.columns).collect()) == sorted(wide.collect())


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["decisions_log", "review_pending", "review_decisions"])
def test_decisions_are_not_copied(spark, name):
    """Each record and scheme has one decision, so none has to be copied to spread a hot key."""
    assert "_salt" not in contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_view_reads_stored_facts(spark):
    """The lines are parsed once and stored; the view and its dimensions read them from there."""
    plan = contract.queries()["classified_view"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [l_orderkey" not in plan


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["review_decisions", "review_pending", "decisions_log"])
def test_only_pending_rows_meet_decisions(spark, name):
    """The rows without a flag are filtered before the join, and its kind lets none through that was not shuffled for a reason."""
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()
    join = next(i for i, line in enumerate(top) if " Join " in f" {line.strip(' :+-')} " and "scheme" in line)
    assert any("Filter" in line and "needs_review" in line for line in top[join + 1:join + 4])


def test_shuffle_files_of_a_stored_table_are_gone(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    seen = {str(b) for b in _blocks(store)}
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "gone")
    assert sorted(r["k"] for r in rows.collect()) == list(range(7)) and spark.conf.get(key, None) == before
    assert not {b for b in map(str, _blocks(store)) if b.startswith("shuffle_")} - seen


def _blocks(store):
    found, n = store.getAllBlocks(), 0
    return [found.apply(n) for n in range(found.size())]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["review_queue_top", "review_queue", "layered_classify"])
def test_rows_are_not_shuffled_to_meet_similar_texts(spark, name):
    """What is similar is stored and sent to the rows; lines meet their supplier by broadcast."""
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_open" in plan and "SortMergeJoin" not in plan


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_a_whole_sort_makes_its_rows_once(spark):
    plan = contract.queries()["review_queue"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Sort [amount_usd") < plan.index("RebalancePartitions [") < plan.index("Generate")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["headline_kpis", "country_overview"])
def test_records_are_classified_once_and_the_register_apart(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")
def test_view_stores_what_it_reads(spark):
    plan = contract.queries()["classified_view"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "description_raw" in plan and "date_raw" not in plan
