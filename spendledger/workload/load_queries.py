"""Whole loads over the driver's tables: charts, missing sources, printed totals, rate findings, arrivals, history."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..functions.text import fold
from ..operators.history import with_previous
from ..operators.rules import first_rules, rules_table
from ..plans import reports
from ..plans.load import Reference, build, control_issues, control_totals, load_source
from ..session import scratch_path, values_table
from ..sources.grid import chart_of_accounts, grid_records
from ..sources.warehouse import Warehouse
from ..streaming.arrivals import load_arrivals
from . import feeds
from .ledger_queries import _AT, _GRID_SPEC, delivery, order_grid, order_spec
from .registry import query


def _reference(spark: SparkSession, sure: bool = True) -> Reference:
    about = {"authoritative": sure, "rate_source": "fixed", "period": "1996"}
    return Reference(feeds.fx(spark), about, feeds.mapping(spark), feeds.RULES)


@query("chart_from_grid", """
SELECT 'C9' AS country_code, p_brand || '-' || p_partkey AS account_code, p_name AS label, p_partkey + 1 AS row_no
FROM part WHERE p_partkey % 7 <> 0
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of accounts in one sheet for each brand, its columns found by name; rows without a code are skipped."""
    part = feeds.table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 7 != 0, F.concat_ws("-", "p_brand", "p_partkey"))
    rows = part.select(F.col("p_brand").alias("source_file"), (F.col("p_partkey") + 1).alias("row_no"), F.array(F.col("p_size").cast("string"), "p_name", code).alias("cells"))
    head = part.select(F.col("p_brand").alias("source_file")).distinct().select(
        "source_file", F.lit(0).cast("long").alias("row_no"), F.array(F.lit("size"), F.lit("wording"), F.lit("chapter")).alias("cells"))
    grid = head.unionByName(rows).withColumn("source_sheet", F.lit("chart"))
    spec = SourceSpec("C9", chart_sheet="chart", chart_code_column="chapter", chart_label_column="wording")
    return chart_of_accounts(grid, spec)


@query("src_control_total", """
SELECT 'SRC_CONTROL_TOTAL' AS rule_code, 'INFO' AS severity, 2 * count(*) AS n, sum(t) + 999999999 * count(*) AS printed FROM (
  SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) + CASE WHEN o_orderstatus = 'P' THEN 12345 ELSE 0 END AS DOUBLE) / 100 AS t
  FROM orders GROUP BY o_orderstatus)
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every printed total stands in the register with its figure, also one that another one follows."""
    _, totals = grid_records(order_grid(spark, sf_dir), _GRID_SPEC)
    found = control_issues(control_totals(totals, _GRID_SPEC), _GRID_SPEC, "B", _AT)
    figure = F.regexp_extract("message", r"total of ([0-9.-]+)", 1).cast("decimal(24,6)")
    return found.groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum(figure).cast("double").alias("printed"))


@query("fx_assumption", """
SELECT step, n AS findings, k AS facts FROM (VALUES ('assumed', 1), ('authoritative', 0)) v(step, n),
  (SELECT count(*) AS k FROM orders WHERE o_orderstatus = 'P')
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding about assumed rates however many loads there were, none once the rates are authoritative."""
    root = scratch_path(spark, "rates")
    wh = Warehouse(spark, f"{root}/ledger")
    path = delivery(feeds.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), f"{root}/in")
    steps = []
    for k, (step, sure) in enumerate((("assumed", False), ("assumed", False), ("authoritative", True))):
        load_source(spark, wh, order_spec("P"), path, _reference(spark, sure), datetime(2025, 1, k + 1))
        version = {"P": wh.versions("P")[-1]}
        steps.append((step, wh.read("issues", version), wh.read("facts", version)))
    out = None
    for step, issues, facts in steps[1:]:
        one = issues.agg(F.count_if(F.col("rule_code") == "FX_ASSUMED_RATES").alias("findings")).crossJoin(  # two single rows
            facts.agg(F.count(F.lit(1)).alias("facts"))).select(F.lit(step).alias("step"), "findings", "facts")
        out = one if out is None else out.unionByName(one)
    return out


@query("missing_source", """
SELECT o_orderstatus AS country_code, false AS skipped, count(*) AS facts FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY 1
UNION ALL SELECT 'X', true, 0
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build over three sources, one of which was not delivered."""
    root, orders = scratch_path(spark, "missing"), feeds.table(spark, sf_dir, "orders")
    specs = {c: order_spec(c, c) for c in ("F", "P", "X")}
    for c in ("F", "P"):
        delivery(orders.where(F.col("o_orderstatus") == c), f"{root}/in/{c}")
    wh = Warehouse(spark, f"{root}/ledger")
    none = values_table(spark, [], "country_code string, country_name string, primary_currency string, language string")
    summary = build(spark, wh, specs, f"{root}/in", none, _reference(spark), _AT)
    listed = values_table(spark, [(c, c in summary["skipped"]) for c in specs], "country_code string, skipped boolean")
    facts = wh.read("facts").groupBy("country_code").agg(F.count(F.lit(1)).alias("facts"))
    return listed.join(facts, "country_code", "left").select("country_code", "skipped", F.coalesce("facts", F.lit(0)).alias("facts"))


@query("arrivals", """
SELECT 'P' AS country_code, count(*) AS facts, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total, 1 AS loads
FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streamed folder: a delivery, then a second one that replaces it; what was seen is not loaded again."""
    root = scratch_path(spark, "arrivals")
    wh = Warehouse(spark, f"{root}/ledger")
    orders = feeds.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    for part in (orders, orders.where("o_orderkey % 2 = 0")):
        delivery(part.coalesce(1), f"{root}/in")  # one file is one delivery
        stream = load_arrivals(spark, wh, order_spec("P"), f"{root}/in", _reference(spark), f"{root}/seen")
        stream.awaitTermination()
    loads = wh.read("batches").agg(F.count(F.lit(1)).cast("int")).scalar()
    return wh.read("facts").groupBy("country_code").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("amount_original").cast("double").alias("total")).withColumn("loads", loads)


@query("trace_history", """
SELECT o_orderkey AS row_no, 'SHA' AS scheme, CAST(s AS BIGINT) AS seq, CASE s WHEN 1 THEN NULL WHEN 2 THEN 'HC.1' ELSE 'HC.7' END AS code,
       s = CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS is_current
FROM orders, (VALUES (1), (2), (3)) v(s) WHERE o_orderpriority = '1-URGENT' AND (s < 3 OR o_orderkey % 3 = 0)
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classifications of the urgent orders in two or three runs, the live one marked."""
    orders, key = feeds.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = [F.lit("O").alias("country_code"), F.lit("1").alias("batch_id"), F.lit("orders").alias("source_file"),
             F.lit("").alias("source_sheet"), key.alias("row_no"), F.lit(0).alias("child_pos")]
    runs = F.when(key % 3 == 0, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(F.lit(1), F.lit(2)))
    history = orders.select(*place, F.lit("SHA").alias("scheme"), F.explode(runs.cast("array<long>")).alias("seq")).withColumns({
        "code": F.when(F.col("seq") == 2, "HC.1").when(F.col("seq") == 3, "HC.7"), "method": F.lit("keyword")})
    hits = orders.where("o_orderpriority = '1-URGENT'").select(*place)
    return reports.trace_history(history, hits).select("row_no", "scheme", "seq", "code", "is_current")


@query("history_any_sequence", """
SELECT event_type, event_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS previous_user_id FROM events
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessors on a few keys that hold all rows, by numbers as far apart as microseconds."""
    events = feeds.table(spark, sf_dir, "events").select(
        "event_type", "event_id", "user_id", (F.col("event_id") * 1_000_003 + 1_600_000_000_000_000).alias("seq"))
    return with_previous(events, ["event_type"], "seq", "user_id").select("event_type", "event_id", "previous_user_id")


@query("rules_indexed", r"""
WITH name AS (SELECT DISTINCT p_name FROM part),
rule AS (SELECT string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] AS phrase, min(p_partkey) AS position
  FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1)
SELECT p_name AS folded, min(position) AS position, 'R' || min(position) AS rule_id
FROM name JOIN rule ON contains(' ' || p_name || ' ', ' ' || phrase || ' ') GROUP BY p_name
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three parts give a rule for the first two words of their names; every name gets the first rule it matches."""
    part = feeds.table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    rules = part.where("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("position"), F.concat(F.lit("R"), "p_partkey").alias("rule_id"),
        F.concat(F.lit(r"\b("), words[0], F.lit(" "), words[1], F.lit(r")\b")).alias("pattern"))
    return first_rules(part.select(fold(F.col("p_name")).alias("folded")), rules).select("folded", "position", "rule_id")


@query("rules_from_indexed_table", r"""
SELECT l_partkey, CASE WHEN regexp_matches(p_name, '\b(ring|rod)\b') THEN 'W-METAL' WHEN regexp_matches(p_name, '\banvil\b') THEN 'W-ANVIL'
  WHEN regexp_matches(p_name, '\bblue\b') THEN 'W-BLUE' END AS rule_id, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured rules as a table, found for each distinct text and joined back to the rows."""
    part = feeds.table(spark, sf_dir, "part").select("p_partkey", fold(F.col("p_name")).alias("folded"))
    item = feeds.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = item.join(part, F.col("l_partkey") == F.col("p_partkey"))
    found = first_rules(part.select("folded"), rules_table(spark, feeds.RULES.sha)).select("folded", "rule_id")
    return rows.join(found, "folded", "left").select("l_partkey", "rule_id", "n")
