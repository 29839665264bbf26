"""Landing, register, splits, canonical spelling, dimensions and maintenance over the driver's tables."""
from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourceSpec, catalogue_table
from ..operators.canonical import canonical_spellings, spelling_counts, variant_issues
from ..operators.classify import guard_text
from ..operators.dims import (
    accounts, canonical_labels, complete_countries, ministries, override_countries, override_scheme,
)
from ..operators.harmonise import harmonise
from ..operators.history import current
from ..operators.landing import project_canonical, stage
from ..operators.maintenance import (
    check_country_edits, check_reference_edits, edit_mapping, reference_overrides,
)
from ..operators.quality import collision_issues, id_collisions, register, row_issues
from ..operators.splits import counted_totals, reconcile_splits
from ..operators.validate import column_checks, foreign_key_check, unique_check
from ..plans import reports
from ..plans.load import (
    Reference, batch_close_issues, control_totals, last_total, load_source, record_decisions,
)
from ..session import scratch_path, stored, values_table
from ..sources.delimited import read_delimited
from ..sources.grid import grid_records
from ..sources.json_records import read_json_array, read_json_lines, source_metadata, stage_json
from ..sources.reference import read_countries, read_scheme
from ..sources.warehouse import Warehouse, export_csv
from . import feeds
from .answers import LINES, REGISTER, SPLITS, with_
from .registry import query

_AT = datetime(2025, 1, 1)


def full_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules, id collisions and guard findings of the ledger of order lines.

    The rules parse each line once; collisions read ids and positions alone, so nothing is stored in between.
    """
    rows, ids = feeds.ledger(spark, sf_dir), feeds.ledger(spark, sf_dir, dealt=False)
    return register(row_issues(guard_text(rows, feeds.RULES), feeds.SPECS, _AT), collision_issues(ids, feeds.SPECS, _AT))


# ------------------------------------------------------------------ landing

@query("landing_roundtrip", with_(SPLITS, """
SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR) AS source_record_id, o_orderpriority AS account_code,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS txn_date, CAST(cents AS DOUBLE) / 100 AS amount FROM base
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed verbatim as JSON and projected back through the field map."""
    spec = SourceSpec("C1", path="orders", field_map={
        "source_record_id": "o_orderkey", "txn_date": "day", "account_code": "o_orderpriority",
        "amount": "o_totalprice", "description": "o_orderstatus"}, currency="USD", date_formats=("%Y-%m-%d",))
    orders = feeds.table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source_file"), F.col("o_orderkey").alias("row_no"), "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    landed = stage(orders, spec, "B1", _AT)
    rows = harmonise(project_canonical(landed, [spec]), [spec], feeds.fx(spark))
    return rows.select("row_no", "source_record_id", "account_code", F.col("txn_date").cast("string").alias("txn_date"),
                       F.col("amount_original").cast("double").alias("amount"))


@query("csv_export_import", """
SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ids, 0 AS n_bad_ordinals,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total FROM orders
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report exported as CSV and read back as a source: nothing lost, ordinals gapless per file."""
    path = scratch_path(spark, "orders-csv")
    export_csv(feeds.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), "o_orderpriority"), path)
    rows = read_delimited(spark, path, SourceSpec("C1"))
    per_file = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    bad = per_file.agg(F.count_if((F.col("lo") != 2) | (F.col("hi") != F.col("n") + 1))).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_ids"),
        F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("total"),
    ).select("n", "n_ids", bad.cast("int").alias("n_bad_ordinals"), "total")


@query("json_lines_feed", """
SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total FROM events GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, landed and harmonised."""
    path = scratch_path(spark, "events-json")
    feeds.table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        (F.round(F.col("value") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("value"),
    ).write.mode("overwrite").json(path)
    spec = SourceSpec("C1", reader="jsonl", currency="USD", date_formats=("%Y-%m-%d",), field_map={
        "source_record_id": "event_id", "txn_date": "at", "account_code": "event_type", "amount": "value"})
    landed = stage(read_json_lines(spark, path), spec, "B1", _AT)
    rows = harmonise(project_canonical(landed, [spec]), [spec], feeds.fx(spark))
    return rows.groupBy(F.col("account_code").alias("event_type")).agg(
        F.count("txn_date").alias("n"), F.count_distinct("source_record_id").alias("n_ids"),
        F.sum("amount_original").cast("double").alias("total"))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one printed sheet per status: banner, header, rows, blank line, total (one of them wrong)."""
    orders = feeds.table(spark, sf_dir, "orders")
    cents = feeds.cents_of("o_totalprice")
    text = F.when(F.col("o_orderkey") % 2 == 0, feeds.amount_text(cents, F.lit(3))).otherwise(
        feeds.amount_text(cents, F.lit(2)))
    body = orders.select(
        F.concat("o_orderstatus", F.lit(".grid")).alias("source_file"), F.lit("Orders").alias("source_sheet"),
        (F.col("o_orderkey") + 10).alias("row_no"),
        F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "dd-MM-yyyy"),
                F.col("o_orderpriority"), text).alias("cells"))
    per_file = orders.groupBy(F.concat("o_orderstatus", F.lit(".grid")).alias("source_file")).agg(
        F.sum(cents).alias("cents"), F.max("o_orderkey").alias("last"))
    printed = F.col("cents") + F.when(F.col("source_file") == "P.grid", 12345).otherwise(0)
    def line(at: Column, *cells) -> Column:
        return F.struct(at.cast("long").alias("row_no"), F.array(*[
            c if isinstance(c, Column) else F.lit(c).cast("string") for c in cells]).alias("cells")
        ).cast("struct<row_no:bigint,cells:array<string>>")

    extra = per_file.select("source_file", F.lit("Orders").alias("source_sheet"), F.inline(F.array(
        line(F.lit(1), "Report", None, "", None),
        line(F.lit(4), "ID ", "day", "Priority", "amount"),
        line(F.lit(5), "TOTAL", None, None, "999999999,00"),  # carried forward from elsewhere: the last total counts
        line(F.col("last") + 11, "", " ", None, None),
        line(F.col("last") + 12, " Total", None, None, feeds.amount_text(printed, F.lit(3))),
    )))
    return body.unionByName(extra)


_GRID_SPEC = SourceSpec(
    "C2", reader="grid", sheet="Orders", header_row=2, total_row_marker="TOTAL", currency="XOF",
    date_formats=("%d-%m-%Y",), decimal_separator=",",
    field_map={"source_record_id": "ID", "txn_date": "day", "account_code": "Priority", "amount": "amount"})


@query("control_total", """
SELECT o_orderstatus || '.grid' AS source_file, count(*) + 2 AS rows_read, count(*) AS rows_staged,
       CAST(sum(c) + CASE WHEN o_orderstatus = 'P' THEN 12345 ELSE 0 END AS DOUBLE) / 100 AS control_total,
       CAST(sum(c) AS DOUBLE) / 100 AS loaded_total,
       CASE WHEN o_orderstatus = 'P' THEN -123.45 ELSE 0.0 END AS difference, o_orderstatus = 'P' AS mismatch
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY o_orderstatus
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids to records, printed totals set apart, loads reconciled, mismatches registered."""
    data, totals = grid_records(order_grid(spark, sf_dir), _GRID_SPEC)
    landed = stage(data, _GRID_SPEC, "B", _AT)
    rows = harmonise(project_canonical(landed, [_GRID_SPEC]), [_GRID_SPEC], feeds.fx(spark))
    loaded = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_staged"),
        F.round(F.sum(F.when(F.col("is_countable"), F.col("amount_original"))), 2).alias("loaded_total"))
    printed = last_total(control_totals(totals, _GRID_SPEC), "source_file")
    batches = loaded.join(printed, "source_file", "left").select(
        F.lit("C2").alias("country_code"), F.col("source_file").alias("batch_id"), "source_file",
        (F.col("rows_staged") + F.coalesce("n_totals", F.lit(0))).alias("rows_read"), "rows_staged",
        F.lit(None).cast("long").alias("declared_records"), "control_total", "loaded_total")
    raised = batch_close_issues(batches).where("rule_code = 'CONTROL_TOTAL_MISMATCH'").select(
        F.col("batch_id").alias("source_file"), F.lit(True).alias("raised"))
    return batches.join(raised, "source_file", "left").select(
        "source_file", "rows_read", "rows_staged", F.col("control_total").cast("double").alias("control_total"),
        F.col("loaded_total").cast("double").alias("loaded_total"),
        F.round(F.col("loaded_total") - F.col("control_total"), 2).cast("double").alias("difference"),
        F.coalesce("raised", F.lit(False)).alias("mismatch"))


@query("json_documents", """
SELECT count(*) AS records, count(*) AS declared, count_if(CAST(o_orderdate AS DATE) > DATE '1997-01-01') AS after_extraction,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total FROM orders
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in many JSON documents, each with a metadata block that counts its own records."""
    entry = F.struct(F.col("o_orderkey").alias("no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
                     F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    docs = feeds.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 40).alias("doc")).agg(F.collect_list(entry).alias("entries"))
    about = F.struct(F.size("entries").alias("recordCount"), F.lit("1997-01-01T08:00:00Z").alias("takenAt"))
    path = scratch_path(spark, "documents-json")
    docs.select("doc", F.to_json(F.struct(about.alias("about"), F.struct("entries").alias("body"))).alias("value")).write.partitionBy("doc").text(path)
    spec = SourceSpec("C1", reader="json", records_path="body.entries", metadata_path="about", metadata_extracted_at="takenAt",
                      currency="USD", date_formats=("%Y-%m-%d",), field_map={"source_record_id": "no", "txn_date": "day", "amount": "value"})
    meta = source_metadata(spark, path, spec)
    canonical = project_canonical(stage_json(spark, path, spec, "B1", _AT), [spec]).join(meta.select("source_file", "extracted_on"), "source_file")
    rows = harmonise(canonical, [spec], feeds.fx(spark))
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("after_extraction").alias("after_extraction"),
        F.sum("amount_original").cast("double").alias("total"),
    ).select("records", meta.agg(F.sum("declared_records")).scalar().alias("declared"), "after_extraction", "total")


@contextmanager
def _small_blocks(spark: SparkSession, size: str = "256k") -> Iterator[None]:
    """Files are read in blocks of this size, as large ones would be in blocks of 128 MiB."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: Bytes of text in a file that a query writes to read it back.
_FILE_BYTES = 64 << 20


def _in_files(rows: DataFrame, size: Column) -> DataFrame:
    """The rows dealt to tasks that write one file each: three, and more where those would exceed ``_FILE_BYTES``; ``size`` is a row's bytes."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.repartition(max(3, math.ceil(total / _FILE_BYTES)))


def _framed(head: str, tail: str):
    """Each partition's records between two lines."""
    def run(batches):
        yield pa.record_batch([pa.array([head])], names=["value"])
        yield from batches
        yield pa.record_batch([pa.array([tail])], names=["value"])
    return run


@query("json_array_blocks", """
SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, sum(length(props)) AS props_chars,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total, 0 AS n_bad_ordinals FROM events GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents with one long array each, whose texts hold brackets and quotes, cut by all tasks that read a block."""
    path = scratch_path(spark, "array-json")
    record = F.to_json(F.struct("event_id", "event_type", "props", (F.round(F.col("value") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("value")))
    records = feeds.table(spark, sf_dir, "events").select(F.concat(record, F.lit(",")).alias("value"))
    _in_files(records, F.octet_length("value")).mapInArrow(
        _framed('{"about": {"made": [1, 2]}, "body": {"other": [{"x": "]"}], "entries": [', 'null], "end": "}"}}'), "value string").write.text(path)
    with _small_blocks(spark):
        rows = read_json_array(spark, path, SourceSpec("C1", reader="json", records_path="body.entries"))
    last = rows.groupBy("source_file").agg(F.max("row_no").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("row_no").alias("d"),
                                           F.max_by(F.col("payload") == "null", "row_no").alias("ends"))
    bad = last.agg(F.count_if((F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")) | ~F.col("ends"))).scalar()
    doc = F.try_parse_json("payload")
    field = lambda name, kind: F.try_variant_get(doc, f"$.{name}", kind)
    events = rows.where("payload <> 'null'").select(
        field("event_type", "string").alias("event_type"), field("event_id", "long").alias("id"), field("props", "string").alias("props"),
        field("value", "decimal(18,2)").alias("value"))
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.sum(F.char_length("props")).alias("props_chars"),
        F.sum("value").cast("double").alias("total")).withColumn("n_bad_ordinals", bad.cast("int"))


@query("csv_multiline_blocks", """
SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS n_ids, sum(length(text)) AS chars,
       CAST(sum(CAST('0x' || md5(text)[1:8] AS BIGINT)) AS DOUBLE) AS digest, 0 AS n_bad_ordinals
FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many lines as quoted fields, read back in blocks that cut through them."""
    path = scratch_path(spark, "texts-csv")
    texts = feeds.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text")
    _in_files(texts, F.octet_length("text")).write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    with _small_blocks(spark):
        rows = read_delimited(spark, path, SourceSpec("C1", multiline=True))
    per_file = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("lo"), F.max("row_no").alias("hi"), F.count_distinct("row_no").alias("d"))
    bad = per_file.agg(F.count_if((F.col("lo") != 2) | (F.col("hi") != F.col("n") + 1) | (F.col("d") != F.col("n")))).scalar()
    digest = F.conv(F.substring(F.md5(F.encode("text", "UTF-8")), 1, 8), 16, 10).cast("long")
    return rows.groupBy(F.nullif("lang", F.lit("")).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.sum(F.char_length("text")).alias("chars"),
        F.sum(digest).cast("double").alias("digest")).withColumn("n_bad_ordinals", bad.cast("int"))


@query("reference_lists", """
SELECT r_name AS name, 'HC.' || r_regionkey AS code, CASE WHEN r_regionkey % 2 = 0 THEN 'note, ' || r_name END AS notes FROM region
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country list and a code list written as CSV and read as references; a repeated code keeps its last row."""
    region = feeds.table(spark, sf_dir, "region")
    code, path = F.concat(F.lit("HC."), "r_regionkey"), scratch_path(spark, "lists")
    rows = region.select(code.alias("sha_code"), F.lit("old").alias("sha_description"), F.lit("x").alias("notes")).unionByName(
        region.select(code.alias("sha_code"), F.col("r_name").alias("sha_description"),
                      F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("note, "), "r_name")).alias("notes")))
    export_csv(rows.orderBy(F.col("sha_description") != "old").coalesce(1), f"{path}/schemes")
    export_csv(region.select(code.alias("country_code"), F.col("r_name").alias("country_name"), F.lit("USD").alias("primary_currency")),
               f"{path}/countries")
    scheme = read_scheme(spark, f"{path}/schemes", "sha")
    return scheme.join(read_countries(spark, f"{path}/countries"), F.col("code") == F.col("country_code")).where(
        "country_name = description").select(F.col("country_name").alias("name"), "code", "notes")


@query("declared_count", """
SELECT o_orderstatus AS batch_id, count(*) AS rows_staged,
       count(*) + CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END AS declared_records,
       o_orderstatus = 'F' AS mismatch FROM orders GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record counts a source declares against the rows staged."""
    staged = feeds.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows_staged"))
    batches = staged.select(
        F.lit("C1").alias("country_code"), "batch_id", "rows_staged",
        (F.col("rows_staged") + F.when(F.col("batch_id") == "F", 3).otherwise(0)).alias("declared_records"),
        F.lit(None).cast("decimal(24,6)").alias("control_total"), F.lit(None).cast("decimal(24,6)").alias("loaded_total"))
    raised = batch_close_issues(batches).where("rule_code = 'SRC_COUNT_MISMATCH'").select(
        "batch_id", F.lit(True).alias("raised"))
    return batches.join(raised, "batch_id", "left").select(
        "batch_id", "rows_staged", "declared_records", F.coalesce("raised", F.lit(False)).alias("mismatch"))


# ----------------------------------------------------------------- register

@query("dq_register_summary", with_(REGISTER, """
SELECT rule_code, severity, country_code, count(*) AS issues FROM register GROUP BY ALL
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issues_by_rule(full_register(spark, sf_dir))


@query("dq_severity", with_(REGISTER, """
SELECT severity, count(*) AS n, count(DISTINCT rule_code) AS rules FROM register GROUP BY 1
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issues_by_severity(full_register(spark, sf_dir))


@query("dq_catalogue", with_(REGISTER, """
SELECT rule_code, c.severity, stage, count(r.row_no) AS fired FROM (VALUES
  ('AMOUNT_MISSING', 'WARN', 'harmonise'), ('AMOUNT_NEGATIVE', 'INFO', 'harmonise'),
  ('AMOUNT_SEPARATOR_AMBIGUOUS', 'WARN', 'harmonise'), ('AMOUNT_UNPARSEABLE', 'ERROR', 'harmonise'),
  ('CONTROL_TOTAL_MISMATCH', 'WARN', 'reconcile'), ('DATE_OUT_OF_PERIOD', 'ERROR', 'harmonise'),
  ('DATE_UNPARSEABLE', 'WARN', 'harmonise'), ('DESCRIPTION_CASE_VARIANTS', 'INFO', 'harmonise'),
  ('DESCRIPTION_MISSING', 'INFO', 'harmonise'), ('FX_ASSUMED_RATES', 'WARN', 'load'),
  ('FX_RATE_MISSING', 'WARN', 'harmonise'), ('SOURCE_ID_COLLISION', 'ERROR', 'harmonise'),
  ('SRC_CONTROL_TOTAL', 'INFO', 'ingest'), ('SRC_COUNT_MISMATCH', 'WARN', 'ingest'),
  ('SUBTXN_SUM_MISMATCH', 'ERROR', 'harmonise'), ('UNTRUSTED_TEXT_IN_DESCRIPTION', 'ERROR', 'classify')
) c(rule_code, severity, stage) LEFT JOIN register r USING (rule_code) GROUP BY ALL
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_catalogue(catalogue_table(spark), full_register(spark, sf_dir))


@query("dq_row_status", with_(LINES, """
SELECT country_code, dq_status, count(*) AS n FROM typed GROUP BY ALL
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.ledger(spark, sf_dir).groupBy("country_code", "dq_status").agg(F.count(F.lit(1)).alias("n"))


@query("dq_drilldown", with_(REGISTER, """
SELECT rule_code, country_code, row_no, source_record_id, 'lineitem' AS source_file FROM register
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole register with the source position behind each finding."""
    positions = reports.issue_positions(full_register(spark, sf_dir))
    return positions.select("rule_code", "country_code", "row_no", "source_record_id", "source_file")


def _unparseable(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    positions = reports.issue_positions(row_issues(feeds.ledger(spark, sf_dir), feeds.SPECS, _AT))
    return reports.issue_detail(positions, "AMOUNT_UNPARSEABLE", limit).select("country_code", "row_no", "source_record_id")


@query("dq_detail", with_(REGISTER, """
SELECT country_code, row_no, source_record_id FROM register WHERE rule_code = 'AMOUNT_UNPARSEABLE'
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unparseable(spark, sf_dir)


@query("dq_detail_top", with_(REGISTER, """
SELECT country_code, row_no, source_record_id FROM register WHERE rule_code = 'AMOUNT_UNPARSEABLE'
ORDER BY country_code, row_no LIMIT 300
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unparseable(spark, sf_dir, 300)


@query("source_id_collision", """
SELECT l_orderkey, l_linenumber, l_partkey, first_position, occurrences FROM (
  SELECT *, l_partkey * 10000000 + l_suppkey AS position,
         min(l_partkey * 10000000 + l_suppkey) OVER w AS first_position, count(*) OVER w AS occurrences
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) WHERE position <> first_position
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") * 10000000 + F.col("l_suppkey")).alias("position"))
    found = id_collisions(rows, ["l_orderkey", "l_linenumber"], ["position"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey",
                        F.col("first_position.position").alias("first_position"), "occurrences")


@query("domain_checks", """
SELECT 'lineitem' AS table_name, 'not_null:l_orderkey' AS check_name, count_if(l_orderkey IS NULL) AS violations FROM lineitem
UNION ALL SELECT 'lineitem', 'not_null:l_shipdate', count_if(l_shipdate IS NULL) FROM lineitem
UNION ALL SELECT 'lineitem', 'domain:l_returnflag', count_if(l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'lineitem', 'domain:l_linestatus', count_if(l_linestatus NOT IN ('O', 'F')) FROM lineitem
UNION ALL SELECT 'lineitem', 'unique:l_orderkey,l_linenumber',
  CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'lineitem', 'foreign_key:l_orderkey', count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = feeds.table(spark, sf_dir, "lineitem")
    closed = feeds.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return column_checks(
        item, "lineitem", ["l_orderkey", "l_shipdate"], {"l_returnflag": ["A", "N"], "l_linestatus": ["O", "F"]}
    ).unionByName(unique_check(item, "lineitem", ["l_orderkey", "l_linenumber"])).unionByName(
        foreign_key_check(item, "lineitem", "l_orderkey", closed, "o_orderkey"))


# ------------------------------------------------------------------- splits

_RECONCILED = r"""
kids AS (SELECT l_orderkey, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS kids FROM lineitem GROUP BY 1),
fam AS (
  SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(kids, 0) AS kids,
         CASE WHEN o_orderkey % 10 = 0 OR n IS NULL THEN CAST(round(o_totalprice * 100) AS BIGINT)
              WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN kids + 1 ELSE kids END AS parent
  FROM orders LEFT JOIN kids ON o_orderkey = l_orderkey),
judged AS (SELECT *, n > 0 AND parent IS NOT NULL AND abs(kids - parent) <= 1 AS ok FROM fam)
"""


def _order_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = feeds.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (feeds.cents_of("l_extendedprice").cast("decimal(18,0)") / 100).cast("decimal(24,6)").alias("amount"))
    totals = item.groupBy("l_orderkey").agg(F.sum("amount").alias("kids"))
    orders = feeds.table(spark, sf_dir, "orders")
    own = (feeds.cents_of("o_totalprice").cast("decimal(18,0)") / 100).cast("decimal(24,6)")
    key = F.col("o_orderkey")
    parent = (
        F.when((key % 10 == 0) | F.col("kids").isNull(), own)
        .when(key % 13 == 0, F.lit(None)).when(key % 11 == 0, F.col("kids") + F.lit("0.01").cast("decimal(4,2)"))
        .otherwise(F.col("kids")).cast("decimal(24,6)")
    )
    parents = orders.join(totals, key == F.col("l_orderkey"), "left").select("o_orderkey", parent.alias("parent_amount"))
    children = item.withColumnRenamed("l_orderkey", "o_orderkey")
    return reconcile_splits(parents, children, ["o_orderkey"], "parent_amount", "amount")


@query("split_reconcile", with_(_RECONCILED, """
SELECT o_orderkey, CASE WHEN n > 0 THEN 'PARENT' ELSE 'STANDALONE' END AS record_level, n AS n_children,
       CASE WHEN n > 0 THEN ok END AS split_reconciles, n = 0 OR NOT ok AS parent_countable FROM judged
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_families(spark, sf_dir).select(
        "o_orderkey", "record_level", "n_children", "split_reconciles", "parent_countable")


@query("double_count", with_(_RECONCILED, """
SELECT CAST(sum(coalesce(parent + kids, 0)) AS DOUBLE) / 100 AS naive_total, CAST(sum(parent) AS DOUBLE) / 100 AS parents_only,
       CAST(sum(CASE WHEN n = 0 OR NOT ok THEN parent ELSE kids END) AS DOUBLE) / 100 AS counted_once,
       count_if(n > 0 AND NOT ok) AS mismatched_splits FROM judged
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = counted_totals(_order_families(spark, sf_dir), "parent_amount")
    return totals.select(*[F.col(c).cast("double").alias(c) for c in ("naive_total", "parents_only", "counted_once")],
                         "mismatched_splits")


@query("split_explode", with_(SPLITS, """
SELECT o_orderkey AS row_no, 0 AS child_pos, CASE WHEN n IS NULL THEN 'STANDALONE' ELSE 'PARENT' END AS record_level,
       CAST(o_orderkey AS VARCHAR) AS source_record_id, CAST(cents AS DOUBLE) / 100 AS amount, NOT coalesce(ok, false) AS is_countable,
       CASE WHEN CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'WARN' ELSE 'OK' END AS dq_status
FROM family LEFT JOIN verdicts USING (o_orderkey)
UNION ALL SELECT o_orderkey, pos, 'CHILD', o_orderkey || '.' || pos, CAST(amount AS DOUBLE) / 100, ok,
       CASE WHEN ok THEN 'OK' ELSE 'WARN' END FROM parts JOIN verdicts USING (o_orderkey)
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON records: children exploded and reconciled inside their row."""
    spec = feeds.SPECS[1]
    rows = harmonise(project_canonical(feeds.nested_payload(spark, sf_dir), [spec]), [spec], feeds.fx(spark))
    return rows.select("row_no", "child_pos", "record_level", "source_record_id",
                       F.col("amount_original").cast("double").alias("amount"), "is_countable", "dq_status")


@query("split_issues", with_(SPLITS, """
SELECT o_orderkey AS row_no, 'SUBTXN_SUM_MISMATCH' AS rule_code, 'parts' AS field FROM verdicts WHERE NOT ok
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = feeds.SPECS[1]
    rows = harmonise(project_canonical(feeds.nested_payload(spark, sf_dir), [spec]), [spec], feeds.fx(spark))
    return row_issues(rows, [spec], _AT).where("rule_code = 'SUBTXN_SUM_MISMATCH'").select(
        "row_no", "rule_code", "field")


# ------------------------------------------------- canonical text, dimensions

_SPELLINGS = LINES + r""",
spelt AS (
  SELECT country_code, description AS spelling, lower(description) AS fold_key, count(*) AS n, min(row_no) AS first_row
  FROM typed WHERE description IS NOT NULL GROUP BY ALL),
chosen AS (
  SELECT country_code, fold_key, count(*) AS n_spellings, sum(n) AS n_rows, sum(n) - max(n) AS n_changed,
         max(n) AS top FROM spelt GROUP BY ALL),
winners AS (
  SELECT country_code, fold_key, spelling AS canonical FROM (
    SELECT *, row_number() OVER (PARTITION BY country_code, fold_key ORDER BY n DESC, first_row) AS r FROM spelt) WHERE r = 1)
"""


@query("case_variants", with_(_SPELLINGS, """
SELECT country_code, fold_key, canonical, n_spellings, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_changed AS BIGINT) AS n_changed
FROM chosen JOIN winners USING (country_code, fold_key)
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling_counts(feeds.ledger(spark, sf_dir), ["country_code"], "description", ["row_no"])
    return canonical_spellings(counts, ["country_code"]).select(
        "country_code", "fold_key", "canonical", "n_spellings", "n_rows", "n_changed")


@query("canonical_rewrite", with_(_SPELLINGS, """
SELECT row_no, coalesce(canonical, description) AS description FROM typed t
LEFT JOIN winners w ON t.country_code = w.country_code AND lower(t.description) = w.fold_key
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.canonical_ledger(spark, sf_dir).select("row_no", "description")


@query("variant_issues", with_(_SPELLINGS, """
, groups AS (SELECT country_code, count(*) AS texts, sum(n_spellings) AS spellings, sum(n_changed) AS changed
             FROM chosen WHERE n_spellings > 1 GROUP BY 1),
firsts AS (SELECT country_code, fold_key, min(first_row) AS first_row, count(*) AS n FROM spelt GROUP BY ALL),
widest AS (SELECT country_code, fold_key FROM (
  SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, first_row) AS r FROM firsts) WHERE r = 1)
SELECT country_code, canonical AS raw_value,
  texts || ' descriptions come in more than one casing (' || spellings || ' spellings); ' || changed
    || ' rows now carry the most frequent one. The text as supplied is kept.' AS message
FROM groups g JOIN widest w USING (country_code) JOIN winners USING (country_code, fold_key)
""".replace("\n, groups", ", groups", 1)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.ledger(spark, sf_dir).withColumn("child_pos", F.lit(0))
    return variant_issues(rows).select("country_code", "raw_value", "message")


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of accounts for every third brand of every region, grown from the parts themselves."""
    parts = feeds.table(spark, sf_dir, "part")
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    label = F.when(brand % 2 == 0, F.concat(F.lit(" Chart "), F.col("p_type"))).otherwise(F.lit(None).cast("string"))
    rows = parts.where(brand % 3 == 0).select(
        F.explode(F.array(*[F.lit(f"C{i}") for i in range(5)])).alias("country_code"),
        F.concat(F.lit(" B"), brand).alias("account_code"), label.alias("label"), F.col("p_partkey").alias("row_no"))
    return rows


_LABELS = _SPELLINGS + r""",
charted AS (
  SELECT brand, CASE WHEN brand % 2 = 0 THEN 'Chart ' || arg_max(p_type, p_partkey) END AS label
  FROM (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand FROM part) WHERE brand % 3 = 0 GROUP BY brand),
observed AS (
  SELECT country_code, brand, arg_min(description, row_no) FILTER (description IS NOT NULL) AS label
  FROM typed GROUP BY ALL),
labelled AS (
  SELECT 'C' || r AS country_code, brand, label, 'country_chart_of_accounts' AS source FROM charted, range(5) t(r)
  UNION ALL SELECT country_code, brand, label, 'observed_in_extract' FROM observed
  WHERE brand NOT IN (SELECT brand FROM charted))
"""


@query("account_label_precedence", with_(_LABELS, """
SELECT l.country_code, 'B' || brand AS account_code,
       CASE WHEN source = 'observed_in_extract' THEN canonical ELSE label END AS account_label, source
FROM labelled l LEFT JOIN winners w ON w.country_code = l.country_code AND w.fold_key = lower(label)
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.ledger(spark, sf_dir)
    return canonical_labels(accounts(rows, _chart(spark, sf_dir)), rows).select(
        "country_code", "account_code", "account_label", "source")


@query("account_label_sources", with_(_LABELS, """
SELECT country_code, source, count(*) AS accounts FROM labelled GROUP BY ALL
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_sources(accounts(feeds.ledger(spark, sf_dir), _chart(spark, sf_dir)))


@query("ministry_first_seen", with_(LINES, """
SELECT country_code, ministry_code, arg_min(coalesce(ministry_name, '-'), row_no) AS ministry_name
FROM typed WHERE ministry_code IS NOT NULL OR ministry_name IS NOT NULL GROUP BY country_code, ministry_code
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ministries(feeds.ledger(spark, sf_dir)).select(
        "country_code", "ministry_code", F.coalesce("ministry_name", F.lit("-")).alias("ministry_name"))


@query("country_completion", """
SELECT 'C' || r_regionkey AS country_code, r_name AS country_name, 'en' AS language FROM region WHERE r_regionkey < 3
UNION ALL SELECT 'C' || n_regionkey, min(n_name), 'xx' FROM nation WHERE n_regionkey >= 3 GROUP BY n_regionkey
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = feeds.countries(spark, sf_dir).where("country_code < 'C3'")
    sources = feeds.table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("C"), "n_regionkey").alias("country_code")).agg(
        F.min("n_name").alias("name"), F.lit(None).cast("string").alias("currency"), F.lit("xx").alias("language"))
    return complete_countries(known, sources).select("country_code", "country_name", "language")


@query("reference_overrides", """
SELECT coalesce(CAST(n.n_nationkey AS VARCHAR), o.code) AS code,
       CASE WHEN o.code IS NULL THEN n_name ELSE o.description END AS description,
       CASE WHEN o.code IS NULL THEN n_regionkey || '' ELSE NULL END AS notes,
       CASE WHEN o.code IS NULL THEN 'supplied' WHEN n_name IS NULL THEN 'added' ELSE 'edited' END AS source
FROM nation n FULL JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS description FROM supplier
  WHERE s_suppkey % 7 = 0) o ON CAST(n.n_nationkey AS VARCHAR) = o.code
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplied = feeds.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("description"),
        F.col("n_regionkey").cast("string").alias("notes"))
    edits = feeds.table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(
        F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("description"), F.lit("").alias("notes"))
    return override_scheme(supplied, edits)


@query("country_overrides", """
SELECT coalesce('C' || r_regionkey, o.code) AS country_code,
       CASE WHEN o.code IS NULL THEN r_name ELSE o.name END AS country_name,
       CASE WHEN o.code IS NULL THEN 'en' ELSE 'fr' END AS language
FROM region FULL JOIN (SELECT 'C' || n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey % 3 = 0) o
  ON 'C' || r_regionkey = o.code
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = feeds.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(
        F.concat(F.lit("c"), "n_nationkey").alias("country_code"), F.col("n_name").alias("name"),
        F.lit("eur").alias("currency"), F.lit("fr").alias("language"))
    return override_countries(feeds.countries(spark, sf_dir), edits).select("country_code", "country_name", "language")


@query("reference_edit_guards", """
SELECT CAST(s_suppkey AS VARCHAR) AS code, 'code or description is empty' AS problem FROM supplier WHERE s_suppkey % 11 = 3
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'listed more than once' FROM supplier WHERE s_suppkey % 11 = 4
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'comes with the supplied list and has to stay' FROM supplier WHERE s_suppkey % 11 IN (2, 3) AND s_suppkey % 2 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'still carried by classified records' FROM supplier
  WHERE s_suppkey % 11 IN (2, 3) AND s_suppkey % 2 = 1 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an edited code list: some dropped, some blanked, some repeated."""
    key = F.col("s_suppkey")
    listed = feeds.table(spark, sf_dir, "supplier")
    before = listed.select(key.cast("string").alias("code"), F.col("s_name").alias("description"), F.lit("").alias("notes"),
                           F.when(key % 2 == 0, "supplied").otherwise("added").alias("source"))
    copies = F.when(key % 11 == 2, 0).when(key % 11 == 4, 2).otherwise(1)
    after = listed.select(
        F.concat(F.lit(" "), key.cast("string")).alias("code"),
        F.when(key % 11 == 3, " ").otherwise(F.col("s_name")).alias("description"), F.lit("").alias("notes"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_")).drop("_")
    used = feeds.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_suppkey").cast("string").alias("code"))
    return check_reference_edits(before, after, used)


@query("reference_restore", """
SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name || '!' AS description FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'x' || n_nationkey, n_name FROM nation
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording restored to the supplied one loses its override; codes outside the list keep theirs."""
    listed = feeds.table(spark, sf_dir, "supplier")
    code, same = F.col("s_suppkey").cast("string"), F.col("s_name")
    supplied = listed.select(code.alias("code"), same.alias("description"), F.lit("").alias("notes"))
    shown = listed.select(code.alias("code"), F.when(F.col("s_suppkey") % 3 == 1, F.concat(same, F.lit("!")))
                          .otherwise(same).alias("description"), F.lit(None).cast("string").alias("notes"))
    others = feeds.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("x"), "n_nationkey").alias("code"), F.col("n_name").alias("description"),
        F.lit(None).cast("string").alias("notes"))
    overrides = listed.select(code.alias("code"), F.lit("old").alias("description"),
                              F.lit(None).cast("string").alias("notes")).unionByName(others)
    return reference_overrides(supplied, supplied, overrides, shown).select("code", "description")


@query("country_edit_guards", """
SELECT * FROM (SELECT CASE WHEN s_suppkey % 9 = 1 THEN 'LONGCODE' || s_suppkey WHEN s_suppkey % 9 = 2 THEN 'S-' || s_suppkey
       WHEN s_suppkey % 9 IN (3, 4) THEN 'S' || s_suppkey END AS code,
       CASE s_suppkey % 9 WHEN 3 THEN 'code, name or currency is empty' WHEN 4 THEN 'currency is not three letters'
         ELSE 'code is not one to eight letters or digits' END AS problem FROM supplier)
WHERE code IS NOT NULL
UNION ALL SELECT 'C' || r_regionkey, CASE WHEN r_regionkey < 2 THEN 'part of the supplied countries'
  ELSE 'still has loaded records' END FROM region
WHERE r_regionkey < 2 OR r_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
  JOIN lineitem ON l_suppkey = s_suppkey)
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    after = feeds.table(spark, sf_dir, "supplier").select(
        F.when(key % 9 == 1, F.concat(F.lit("longcode"), key)).when(key % 9 == 2, F.concat(F.lit("s-"), key))
        .otherwise(F.concat(F.lit("s"), key)).alias("code"),
        F.when(key % 9 == 3, F.lit(" ")).otherwise(F.col("s_name")).alias("name"),
        F.when(key % 9 == 4, F.lit("EURO")).otherwise("eur").alias("currency"))
    before = feeds.countries(spark, sf_dir).select(
        F.col("country_code").alias("code"), F.when(F.col("country_code") < "C2", "supplied").otherwise("added").alias("origin"))
    return check_country_edits(before, after, feeds.lines(spark, sf_dir))


@query("mapping_edits", """
WITH m AS (
  SELECT 'C0' AS country_code, p_brand || '-' || p_type AS account_code, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT country_code, account_code,
  CASE k % 6 WHEN 0 THEN 'CLASSIFIED' WHEN 2 THEN 'ADMIN_INPUT' WHEN 3 THEN 'CAPITAL' ELSE 'CLASSIFIED' END AS outcome,
  CASE k % 6 WHEN 0 THEN 'HC.9' WHEN 2 THEN 'HC.7' WHEN 3 THEN NULL ELSE 'HC.1' END AS sha,
  CASE k % 6 WHEN 5 THEN 'SRHR.X' WHEN 0 THEN 'SRHR.MH' WHEN 4 THEN 'SRHR.X' ELSE 'SRHR.NA' END AS srhr,
  CASE WHEN k % 6 IN (4, 5) THEN 0.9 ELSE 0.67 END AS confidence, k % 6 = 2 AS needs_review
FROM m WHERE k % 6 <> 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits over a mapping of (brand, type) codes: removed, skipped, defaulted, rounded."""
    base = feeds.table(spark, sf_dir, "part").groupBy(
        F.concat("p_brand", F.lit("-"), "p_type").alias("account_code")).agg(F.min("p_partkey").alias("k"))
    none, kind = F.lit(None).cast("string"), F.col("k") % 6
    mapping = base.select(
        F.lit("C0").alias("country_code"), "account_code", F.lit("old").alias("label"), F.lit("CLASSIFIED").alias("outcome"),
        F.lit("HC.1").alias("sha"), F.lit("SRHR.X").alias("srhr"), F.lit(0.9).alias("confidence"),
        F.lit(False).alias("needs_review"), none.alias("note"))
    # 0 coded, 1 emptied, 2 input, 3 capital, 4 coded outcome without code (skipped), 5 not edited
    edits = base.where(kind != 5).select(
        F.lit("C0").alias("country_code"), "account_code", F.lit("new").alias("label"),
        F.when(kind == 2, "ADMIN_INPUT").when(kind == 3, "CAPITAL").when(kind == 4, "CLASSIFIED").otherwise(none).alias("outcome"),
        F.when(kind == 0, "HC.9").otherwise("").alias("sha"),
        F.when(kind == 0, "SRHR.MH").otherwise(none).alias("srhr"), F.lit(0.666).alias("confidence"),
        F.lit(False).alias("needs_review"), F.lit("").alias("note"))
    edited, _ = edit_mapping(mapping, edits)
    return edited.select("country_code", "account_code", "outcome", "sha", "srhr", "confidence", "needs_review")


@query("partition_replace", """
SELECT o_orderstatus AS country_code, count(*) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END) AS DOUBLE) / 100 AS total
FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT' GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statuses loaded, then one delivered again with other rows: only that one changes."""
    wh = Warehouse(spark, scratch_path(spark, "replace"))
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    orders = feeds.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("country_code"), F.lit("1").alias("batch_id"), "o_orderkey", "o_orderpriority",
        amount.alias("amount"))
    loads = orders.select("country_code", "batch_id").distinct()
    wh.append("facts", orders)
    wh.append("batches", loads)
    again = orders.where("country_code = 'O' AND o_orderpriority = '1-URGENT'").withColumns(
        {"batch_id": F.lit("2"), "amount": (F.col("amount") * 2).cast("decimal(18,2)")})
    wh.replace_countries("facts", again)
    wh.replace_countries("batches", loads.where("country_code = 'O'").withColumn("batch_id", F.lit("2")))
    return wh.read("facts").groupBy("country_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


def delivery(orders: DataFrame, path: str) -> str:
    """Orders as a delimited extract of several files."""
    orders.select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderpriority").alias("account"), F.col("o_orderpriority").alias("text"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    ).write.mode("append").option("header", True).csv(path)
    return path


def order_spec(code: str, path: str = "orders") -> SourceSpec:
    return SourceSpec(code, path=path, currency="USD", date_formats=("%Y-%m-%d",), field_map={
        "source_record_id": "id", "txn_date": "day", "account_code": "account", "description": "text", "amount": "amount"})


@query("replace_failed_load", """
WITH loaded AS (
  SELECT o_orderstatus AS country_code, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
  WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT')
SELECT country_code, count(*) AS staged, count(*) AS facts, CAST(sum(cents) AS DOUBLE) / 100 AS total, count(*) AS batch_rows,
       CASE country_code WHEN 'F' THEN 2 ELSE 1 END AS versions
FROM loaded GROUP BY country_code
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads, one replaced, one whose replacement fails after its records were staged: readers see what was there."""
    root = scratch_path(spark, "failed-load")
    wh, at = Warehouse(spark, f"{root}/ledger"), datetime(2025, 1, 1)
    orders = feeds.table(spark, sf_dir, "orders")
    reference = Reference(feeds.fx(spark), {"authoritative": True}, feeds.mapping(spark), feeds.RULES)
    for code in ("O", "F", "P"):
        path = delivery(orders.where(F.col("o_orderstatus") == code), f"{root}/first/{code}")
        load_source(spark, wh, order_spec(code), path, reference, at)
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    again = {c: delivery(urgent.where(F.col("o_orderstatus") == c), f"{root}/second/{c}") for c in ("O", "F")}
    load_source(spark, wh, order_spec("F"), again["F"], reference, datetime(2025, 1, 2))
    broken = replace(reference, fx=reference.fx.withColumn("rate", F.raise_error(F.lit("no rates today")).cast("decimal(18,6)")))
    try:
        load_source(spark, wh, order_spec("O"), again["O"], broken, datetime(2025, 1, 2))
        raise AssertionError("the load was to fail")
    except PySparkException as e:
        if "no rates today" not in str(e):
            raise
    staged = wh.read("staged").groupBy("country_code").agg(F.count(F.lit(1)).alias("staged"))
    facts = wh.read("facts").groupBy("country_code").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("amount_original").cast("double").alias("total"))
    batches = wh.read("batches").groupBy("country_code").agg(F.sum("rows_staged").alias("batch_rows"))
    versions = values_table(spark, [(c, len(wh.versions(c))) for c in wh.countries()], "country_code string, versions int")
    return staged.join(facts, "country_code").join(batches, "country_code").join(versions, "country_code")


@query("decisions_appended", """
WITH run AS (
  SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 3 AS kind FROM orders)
SELECT s AS country_code, count(*) + count(*) FILTER (kind = 1) AS history_rows, count(*) AS current_rows,
  count(*) FILTER (kind = 0) AS accepted, count(*) FILTER (kind = 1) AS corrected, count(*) FILTER (kind = 2) AS pending,
  count(*) FILTER (kind < 2) AS appended
FROM run GROUP BY s
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order classified once; a third accepted, a third corrected, by appending only what was decided."""
    wh = Warehouse(spark, scratch_path(spark, "decisions"))
    key = F.col("o_orderkey")
    orders = feeds.table(spark, sf_dir, "orders")
    place = [F.lit("1").alias("batch_id"), F.col("o_orderstatus").alias("country_code"), F.lit("orders").alias("source_file"),
             F.lit("").alias("source_sheet"), key.alias("row_no"), F.lit(0).alias("child_pos"), F.lit("SHA").alias("scheme")]
    none = F.lit(None).cast("string")
    wh.append("classification", orders.select(
        *place, none.alias("code"), F.lit("UNCLASSIFIED").alias("outcome"), F.lit("none").alias("method"), none.alias("rule_id"),
        F.lit(0.0).alias("confidence"), F.lit(True).alias("needs_review"), F.lit("").alias("explanation"),
        F.lit("PENDING").alias("review_status"), none.alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"),
        none.alias("review_note"), F.lit(datetime(2025, 1, 1)).alias("classified_at"), F.lit(1).cast("long").alias("seq")))
    base = {c: wh.manifest(c)["tables"]["classification"]["paths"] for c in wh.countries()}
    record_decisions(wh, orders.where(key % 3 < 2).select(
        *place, F.when(key % 3 == 0, "ACCEPT").otherwise("CORRECT").alias("action"), F.lit("HC.1").alias("new_code"),
        F.lit("ann").alias("reviewed_by"), F.lit("").alias("review_note"), F.lit(datetime(2025, 1, 2)).alias("decided_at"),
        F.lit(1).cast("long").alias("decision_no")))
    if {c: wh.manifest(c)["tables"]["classification"]["paths"] for c in wh.countries()} != base:
        raise AssertionError("the history was written again")
    history = wh.read("classification")
    status = F.col("review_status")
    now = current(history).groupBy("country_code").agg(
        F.count(F.lit(1)).alias("current_rows"), F.count_if(status == "ACCEPTED").alias("accepted"),
        F.count_if(status == "CORRECTED").alias("corrected"), F.count_if(status == "PENDING").alias("pending"))
    return history.groupBy("country_code").agg(F.count(F.lit(1)).alias("history_rows")).join(now, "country_code").join(
        wh.read("decided").groupBy("country_code").agg(F.count(F.lit(1)).alias("appended")), "country_code")
