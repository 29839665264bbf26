"""Every registered query against its independent SQL answer on the smallest tables."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as contract  # noqa: E402
from compare import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF) is None


def test_every_answer_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["country_code", "sha", "records", "total_usd", "warned"] and df.count() > 0


def test_results_do_not_depend_on_partitions(spark, con):
    name, old = "canonical_rewrite", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert difference(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
