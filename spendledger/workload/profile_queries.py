"""Profiling operators over the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, sketches
from ..session import stored
from . import feeds
from .answers import LINES, with_
from .registry import query


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,"
        f" count_if(trim(CAST({c} AS VARCHAR)) = '') AS n_blank, count(DISTINCT {c}) AS n_distinct FROM {table}"
        for c in columns)


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("column_profile", _profile_sql("customer", _CUSTOMER))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(feeds.table(spark, sf_dir, "customer")).drop("samples")


@query("column_samples", """
SELECT 'o_orderstatus' AS column_name, string_agg(v, ' | ' ORDER BY v) AS samples FROM (
  SELECT DISTINCT o_orderstatus AS v FROM orders ORDER BY 1 LIMIT 3)
UNION ALL SELECT 'o_orderpriority', string_agg(v, ' | ' ORDER BY v) FROM (
  SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY 1 LIMIT 3)
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.table(spark, sf_dir, "orders")
    return profile.column_profile(rows, ["o_orderstatus", "o_orderpriority"]).select("column_name", "samples")


@query("text_anomaly_closed", """
WITH v AS (SELECT name, count(*) AS n, length(name) AS len FROM (
  SELECT CASE WHEN p_partkey % 499 = 0 THEN p_type || ' - reviewed and confirmed by the previous audit' ELSE p_type END AS name
  FROM part) GROUP BY ALL)
SELECT 'closed list' AS kind, name AS value, n, CAST(len AS INTEGER) AS length, (SELECT median(len) FROM v) AS typical_length,
  CAST((SELECT max(len) FROM v) AS INTEGER) AS max_length, len > 2 * (SELECT median(len) FROM v) AS is_outlier FROM v
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed list with a few planted long values, each listed with its verdict."""
    planted = F.when(F.col("p_partkey") % 499 == 0,
                     F.concat("p_type", F.lit(" - reviewed and confirmed by the previous audit")))
    rows = feeds.table(spark, sf_dir, "part").select(planted.otherwise(F.col("p_type")).alias("name"))
    return profile.text_anomalies(rows, "name")


@query("text_anomaly_free", """
SELECT 'free text' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS n, CAST(NULL AS INTEGER) AS length,
  CAST(median(length(c_name)) AS DOUBLE) AS typical_length, CAST(max(length(c_name)) AS INTEGER) AS max_length,
  CAST(NULL AS BOOLEAN) AS is_outlier FROM customer
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.text_anomalies(feeds.table(spark, sf_dir, "customer"), "c_name")


@query("date_format_matrix", """
WITH d AS (SELECT *, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS k FROM orders)
SELECT '%d/%m/%Y' AS date_format, count_if(k = 0) AS n_parsed, count_if(k <> 0) AS n_failed,
  CAST(min(d) FILTER (k = 0) AS VARCHAR) AS first_day, CAST(max(d) FILTER (k = 0) AS VARCHAR) AS last_day FROM d
UNION ALL SELECT '%Y-%m-%d', count_if(k = 1), count_if(k <> 1), CAST(min(d) FILTER (k = 1) AS VARCHAR),
  CAST(max(d) FILTER (k = 1) AS VARCHAR) FROM d
UNION ALL SELECT '%d.%m.%Y', count_if(k = 2), count_if(k <> 2), CAST(min(d) FILTER (k = 2) AS VARCHAR),
  CAST(max(d) FILTER (k = 2) AS VARCHAR) FROM d
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = profile.date_format_matrix(_dated(spark, sf_dir), "t", ["%d/%m/%Y", "%Y-%m-%d", "%d.%m.%Y"])
    return matrix.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, at = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(kind == 0, F.date_format(at, "dd/MM/yyyy")).when(kind == 1, F.date_format(at, "yyyy-MM-dd")).otherwise(
        F.date_format(at, "dd.MM.yyyy"))
    return feeds.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))


@query("date_format_vote", """
SELECT CASE WHEN count_if(o_orderkey % 3 = 1) >= greatest(count_if(o_orderkey % 3 = 0), count_if(o_orderkey % 3 = 2)) THEN '%Y-%m-%d'
            WHEN count_if(o_orderkey % 3 = 0) >= count_if(o_orderkey % 3 = 2) THEN '%d/%m/%Y' ELSE '%d.%m.%Y' END AS date_format,
  greatest(count_if(o_orderkey % 3 = 0), count_if(o_orderkey % 3 = 1), count_if(o_orderkey % 3 = 2)) AS votes FROM orders
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.date_format_vote(_dated(spark, sf_dir), "t")


@query("amount_shapes", with_(LINES, """
, u AS (SELECT l_linenumber AS s, cents0 // 100 AS units FROM typed)
SELECT 'plain digits' AS shape, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'comma + 2 decimals', count_if(s = 3) FROM u
UNION ALL SELECT 'one comma, 3 digits', count_if(s = 4 AND units BETWEEN 1000 AND 999999) FROM u
UNION ALL SELECT 'comma groups + suffix', count_if(s = 4 AND units >= 1000) FROM u
UNION ALL SELECT 'space groups + suffix', CAST(0 AS BIGINT)
""".replace("\n, u", ", u", 1)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.amount_shapes(feeds.lines(spark, sf_dir), "amount")


# Where the declared separator alone misreads: grouped digits, and a comma where a point is declared.
_READINGS = """
, read AS (SELECT *,
  CASE WHEN l_linenumber = 2 AND cents0 >= 100000 OR l_linenumber = 3 AND country_code IN ('C0', 'C1', 'C4') THEN NULL
       WHEN l_linenumber = 4 AND country_code = 'C2' AND cents0 >= 100000 THEN cents0 // 100
       ELSE cents * 10 END AS milli,
  l_linenumber = 2 AND cents0 >= 100000 OR l_linenumber = 3 AND country_code IN ('C0', 'C1', 'C4')
    OR l_linenumber = 4 AND country_code = 'C2' AND cents0 >= 100000 AS differs FROM typed)
"""


def _by_source(spark: SparkSession, sf_dir: str, one) -> DataFrame:
    """Each source's rows, rendered once, under the source's own conventions."""
    rows, out = stored(feeds.lines(spark, sf_dir).select("country_code", "row_no", "amount"), "amounts"), None
    for spec in feeds.SPECS:
        part = one(rows.where(F.col("country_code") == spec.country_code), spec)
        out = part if out is None else out.unionByName(part)
    return out


@query("amount_readings", with_(LINES, (_READINGS + """
SELECT country_code, CAST(sum(milli) AS DOUBLE) / 1000 AS declared_total, CAST(sum(cents) AS DOUBLE) / 100 AS structural_total,
  count_if(differs) AS n_disagree FROM read GROUP BY 1
""").replace("\n, read", ", read", 1)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one declared separator would have cost: both readings of the same column, for every source."""
    found = _by_source(spark, sf_dir, lambda rows, spec: profile.amount_readings(
        rows, "amount", spec.decimal_separator, spec.strip_suffixes, ["country_code"]))
    return found.select("country_code", F.col("declared_total").cast("double").alias("declared_total"),
                        F.col("structural_total").cast("double").alias("structural_total"), "n_disagree")


@query("amount_disagreements", with_(LINES, (_READINGS + """
SELECT country_code, row_no, CAST(milli AS DOUBLE) / 1000 AS declared, CAST(cents AS DOUBLE) / 100 AS structural
FROM read WHERE differs
""").replace("\n, read", ", read", 1)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values themselves on which the two readings differ."""
    found = _by_source(spark, sf_dir, lambda rows, spec: profile.amount_disagreements(
        rows, "amount", spec.decimal_separator, spec.strip_suffixes))
    return found.select("country_code", "row_no", F.col("declared").cast("double").alias("declared"),
                        F.col("structural").cast("double").alias("structural"))


@query("amount_convention_vote", with_(LINES, """
SELECT country_code, CASE WHEN count_if(l_linenumber = 3) > count_if(l_linenumber IN (1, 6)) THEN ',' ELSE '.' END AS decimal_separator,
  count_if(l_linenumber = 3) AS comma_decimals, count_if(l_linenumber IN (1, 6)) AS dot_decimals FROM typed GROUP BY 1
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.amount_convention_vote(feeds.lines(spark, sf_dir), "amount", ["country_code"])


@query("amount_suffixes", with_(LINES, """
SELECT country_code, 'FCFA' AS suffix, count(*) AS n FROM typed WHERE l_linenumber = 4 GROUP BY 1
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.amount_suffixes(feeds.lines(spark, sf_dir), "amount", ["country_code"])


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, l_partkey, occurrences FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS occurrences FROM lineitem) WHERE occurrences > 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return profile.duplicates(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("json_keys", """
SELECT unnest(json_keys(j)) AS key, count(*) AS n, CASE WHEN count(*) = (SELECT count(*) FROM events) THEN 'always' ELSE 'sometimes' END AS presence
FROM (SELECT CASE WHEN event_type = 'click' THEN replace(props, '}', ', "extra": 1}') ELSE props END AS j FROM events) GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wider = F.when(F.col("event_type") == "click", F.replace("props", F.lit("}"), F.lit(', "extra": 1}')))
    rows = feeds.table(spark, sf_dir, "events").select(wider.otherwise(F.col("props")).alias("j"))
    return profile.json_key_frequency(rows, "j")


@query("code_lengths", "SELECT CAST(length(p_brand) AS INTEGER) AS code_length, count(*) AS n FROM part GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.code_lengths(feeds.table(spark, sf_dir, "part"), "p_brand")


@query("category_census", """
SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.category_census(feeds.table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("numeric_profile", """
SELECT count_if(c_custkey % 10 <> 0) AS n_numeric, count_if(c_custkey % 10 = 0) AS n_other,
  count_if(c_custkey % 10 <> 0 AND c_acctbal < 0) AS n_negative, count_if(c_custkey % 10 <> 0 AND c_acctbal = 0) AS n_zero,
  min(c_acctbal) FILTER (c_custkey % 10 <> 0) AS least, max(c_acctbal) FILTER (c_custkey % 10 <> 0) AS greatest,
  CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) FILTER (c_custkey % 10 <> 0) AS DOUBLE) / 100 AS total FROM customer
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    rows = feeds.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 10 == 0, F.concat(cents, F.lit(" CR"))).otherwise(cents).alias("balance"))
    found = profile.numeric_profile(rows, "balance")
    return found.withColumns({c: F.col(c).cast("double") for c in ("least", "greatest", "total")})


@query("currency_mix", with_(LINES, """
SELECT currency, count(*) AS n_rows, count(cents) AS n_amounts, round(CAST(sum(cents) AS DOUBLE) / 100 / count(cents), 4) AS mean_amount
FROM typed GROUP BY 1
"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.currency_mix(feeds.ledger(spark, sf_dir), "currency_original", "amount_original")
    return found.withColumn("mean_amount", F.round(F.col("mean_amount").cast("double"), 4))


@query("token_vocabulary", """
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Zàâçéèêëîïôûùüÿœ]+')) AS word FROM documents)
WHERE length(word) > 3 GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vocabulary of every document."""
    return profile.token_vocabulary(feeds.table(spark, sf_dir, "documents"), "text", top=None)


@query("token_top", """
SELECT source, word, n FROM (SELECT 'documents' AS source, word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Zàâçéèêëîïôûùüÿœ]+')) AS word FROM documents)
  WHERE length(word) > 3 GROUP BY ALL ORDER BY n DESC, word LIMIT 18)
UNION ALL SELECT source, word, n FROM (SELECT 'conversations' AS source, word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Zàâçéèêëîïôûùüÿœ]+')) AS word FROM conversations)
  WHERE length(word) > 3 GROUP BY ALL ORDER BY n DESC, word LIMIT 18)
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [profile.token_vocabulary(feeds.table(spark, sf_dir, t), "text", top=18).select(F.lit(t).alias("source"), "word", "n")
             for t in ("documents", "conversations")]
    return parts[0].unionByName(parts[1])


@query("code_overlap", """
WITH k AS (SELECT DISTINCT o_orderpriority AS c, o_custkey AS k FROM orders)
SELECT a.c AS country_a, b.c AS country_b, count(*) AS shared_codes FROM k a JOIN k b ON a.k = b.k AND a.c < b.c GROUP BY ALL
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.code_overlap(feeds.table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


_SKETCHED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("column_sketches", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, true AS distinct_within_bound,"
    f" true AS median_within_bound FROM orders" for c in _SKETCHED))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of each status's orders merged to one, held against exact counts: three standard errors, two ranks in a hundred."""
    orders = feeds.table(spark, sf_dir, "orders")
    merged = sketches.estimates(sketches.merge_sketches(sketches.sketch_columns(
        orders.withColumn("load", F.col("o_orderstatus")), _SKETCHED, by=["load"])))
    wide = orders.agg(*[x for c in _SKETCHED for x in (
        F.count_distinct(F.col(c).cast("string")).alias(f"{c}_n"),
        F.percentile(F.char_length(F.col(c).cast("string")), F.array(F.lit(0.48), F.lit(0.52))).alias(f"{c}_m"))])
    exact = wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("exact"), F.col(f"{c}_m").alias("near")) for c in _SKETCHED])))
    bound = 3 * 1.04 / 2 ** (sketches.LOG_K / 2)
    return merged.join(exact, "column_name").select(
        "column_name", "n_rows", "n_null",
        (F.abs(F.col("n_distinct") - F.col("exact")) <= bound * F.col("exact") + 1).alias("distinct_within_bound"),
        F.col("length_50").between(F.floor(F.col("near")[0]), F.ceil(F.col("near")[1])).alias("median_within_bound"))


@query("column_sketches_by_load", """
SELECT o_orderstatus AS load, count(*) AS n_rows, true AS within_bound, max(length(o_orderpriority)) AS max_length FROM orders GROUP BY 1
""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers of each load from its own sketch, within the bound of the exact count."""
    orders = feeds.table(spark, sf_dir, "orders").withColumn("load", F.col("o_orderstatus"))
    made = sketches.sketch_columns(orders, ["o_custkey", "o_orderpriority"], by=["load"])
    found = sketches.estimates(made).groupBy("load").pivot("column_name", ["o_custkey", "o_orderpriority"]).agg(
        F.first("n_rows").alias("n_rows"), F.first("n_distinct").alias("n"), F.first("max_length").alias("max_length"))
    exact = orders.groupBy("load").agg(F.count_distinct("o_custkey").alias("exact"))
    bound = 3 * 1.04 / 2 ** (sketches.LOG_K / 2)
    return found.join(exact, "load").select(
        "load", F.col("o_custkey_n_rows").alias("n_rows"), (F.abs(F.col("o_custkey_n") - F.col("exact")) <= bound * F.col("exact") + 1).alias("within_bound"),
        F.col("o_orderpriority_max_length").alias("max_length"))
