"""The data-quality register: every rule's output has the same columns and is unioned."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEVERITY, SourceSpec
from .landing import POSITION, RECORD_KEY, convention

ISSUE_COLUMNS = (
    *RECORD_KEY, "source_record_id", "rule_code", "severity", "field", "raw_value", "message", "detected_at",
)
_ISSUE_TYPE = "struct<rule_code:string,severity:string,field:string,raw_value:string,message:string>"


def _issue(rule: str, field: Column, raw_value: Column, message: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_code"),
        F.lit(SEVERITY[rule]).alias("severity"),
        field.cast("string").alias("field"),
        raw_value.cast("string").alias("raw_value"),
        message.alias("message"),
    ).cast(_ISSUE_TYPE)


def _text(*parts: str | Column) -> Column:
    """Concatenate literals and values; a NULL value reads as ``none``."""
    return F.concat(*[
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts
    ])


def row_issues(harmonised: DataFrame, specs: Sequence[SourceSpec], detected_at: datetime | None = None) -> DataFrame:
    """All per-record rules in one pass: each row builds its issues, then they are exploded.

    Rows that went through the guard (``guard_text``) also report what it found.
    """

    def source_field(name: str) -> Column:
        return convention([_Named(s.country_code, s.field_map.get(name)) for s in specs], "column",
                          lambda c: F.lit(c).cast("string"))

    amount, problem = F.col("amount_original"), F.col("amount_problem")
    nothing = F.lit(None).cast("string")
    separator = convention(specs, "decimal_separator", F.lit)
    why = F.concat_ws(
        " and ",
        F.when(F.col("outside_period"),
               _text("outside the declared period ", F.col("period_start"), "..", F.col("period_end"))),
        F.when(F.col("after_extraction"),
               _text("after the extraction date of the source ", F.col("extracted_on"))),
    )
    own = F.col("child_pos") == 0
    split_sum = F.round("split_sum", 2)
    rules = [
        (problem == "missing", _issue(
            "AMOUNT_MISSING", source_field("amount"), F.col("amount_raw"),
            F.lit("No amount given; loaded as NULL and left out of totals."))),
        (problem.startswith("ambiguous"), _issue(
            "AMOUNT_SEPARATOR_AMBIGUOUS", source_field("amount"), F.col("amount_raw"),
            _text("One '", separator, "' followed by three digits although it is the declared decimal"
                  " separator; taken as a thousands mark -> ", amount, ". Confirm with the source."))),
        (problem.startswith("unparseable"), _issue(
            "AMOUNT_UNPARSEABLE", source_field("amount"), F.col("amount_raw"),
            _text("Amount is not a number (", problem, ")."))),
        (F.col("date_problem").isNotNull(), _issue(
            "DATE_UNPARSEABLE", source_field("txn_date"), F.col("date_raw"),
            _text("Posting date does not fit the declared formats (", F.col("date_problem"), ")."))),
        (F.col("outside_period") | F.col("after_extraction"), _issue(
            "DATE_OUT_OF_PERIOD", source_field("txn_date"), F.col("date_raw"),
            _text("Posting date ", F.col("txn_date"), " is ", why, ". Counted as given; confirm the date."))),
        (amount < 0, _issue(
            "AMOUNT_NEGATIVE", source_field("amount"), amount,
            F.lit("Amount below zero, probably a reversal; counted as given."))),
        (F.col("description").isNull(), _issue(
            "DESCRIPTION_MISSING", source_field("description"), nothing,
            F.lit("No description; only the account code can classify this record."))),
        (amount.isNotNull() & F.col("currency_original").isNotNull() & F.col("fx_rate").isNull(), _issue(
            "FX_RATE_MISSING", F.lit("currency"), F.col("currency_original"),
            _text("No rate for ", F.col("currency_original"), "; no USD amount."))),
        (F.col("split_reconciles") == F.lit(False), _issue(
            "SUBTXN_SUM_MISMATCH",
            convention(specs, "child_path", lambda c: F.lit(c).cast("string")),
            _text("parent=", amount, " children_sum=", split_sum),
            _text("Splits add up to ", split_sum, " against a parent of ", amount, " (difference ",
                  F.round(F.col("split_sum") - F.coalesce(amount, F.lit(0)), 2),
                  "). The parent counts; the splits are kept but not counted."))),
    ]
    found = [F.when(own & test, issue) for test, issue in rules]
    if "guard_hits" in harmonised.columns:
        found.append(F.when(F.size("guard_hits") > 0, _untrusted()))
    found = F.array_compact(F.array(*found))
    return harmonised.select(*RECORD_KEY, "source_record_id", F.inline(found)).withColumn(
        "detected_at", F.lit(detected_at).cast("timestamp")).select(*ISSUE_COLUMNS)


class _Named:
    """A spec reduced to one source column name, for ``convention``."""

    def __init__(self, country_code: str, column: str | None):
        self.country_code, self.column = country_code, column


def id_collisions(
    rows: DataFrame,
    group: Sequence[str],
    position: Sequence[str],
) -> DataFrame:
    """Rows whose id already occurred, with the position of its first occurrence.

    First positions come from a partial aggregate, so a hot id is never gathered; only
    ids that repeat are joined back, each once.  The key's hash as a further join key has Spark
    deal both sides anew, and so split a hot id by the measured size of its part.
    """
    key = [group[-1], *group[:-1]]  # rows are sorted by it: ids differ early, countries do not
    named = rows.where(F.col(key[0]).isNotNull() & (F.col(key[0]).cast("string") != ""))
    firsts = (
        named.groupBy(*key)
        .agg(F.min(F.struct(*position)).alias("first_position"), F.count(F.lit(1)).alias("occurrences"))
        .where("occurrences > 1")
    )
    dealt = F.xxhash64(*key).alias("_dealt")
    found = named.select("*", dealt).join(firsts.select("*", dealt), ["_dealt", *key]).drop("_dealt")
    return found.where(F.struct(*position) != F.col("first_position"))


def collision_issues(harmonised: DataFrame, specs: Sequence[SourceSpec],
                     detected_at: datetime | None = None) -> DataFrame:
    """SOURCE_ID_COLLISION: both records are kept, the later one is reported."""
    own = harmonised.where("child_pos = 0").select(*RECORD_KEY, "source_record_id")
    repeated = id_collisions(own, ["country_code", "batch_id", "source_record_id"], POSITION)
    named = [_Named(s.country_code, s.field_map.get("source_record_id")) for s in specs]
    issue = _issue(
        "SOURCE_ID_COLLISION",
        convention(named, "column", lambda c: F.lit(c).cast("string")),
        F.col("source_record_id"),
        _text("Transaction id already used by source row ", F.col("first_position.row_no"),
              "; both are kept, so the id cannot serve as a key."),
    )
    return repeated.select(*RECORD_KEY, "source_record_id", F.inline(F.array(issue))).withColumn(
        "detected_at", F.lit(detected_at).cast("timestamp")).select(*ISSUE_COLUMNS)


def batch_issues(rows: DataFrame, rule: str, field: Column, raw_value: Column, message: Column,
                 detected_at: datetime | None = None) -> DataFrame:
    """Issues about a whole load: rows carry ``country_code, batch_id`` and the figures to print."""
    issue = _issue(rule, field, raw_value, message)
    return rows.select(
        "country_code", "batch_id",
        *[F.lit(None).cast("string").alias(c) for c in (*POSITION[:2], "source_record_id")],
        F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("int").alias("child_pos"),
        F.inline(F.array(issue)),
    ).withColumn("detected_at", F.lit(detected_at).cast("timestamp")).select(*ISSUE_COLUMNS)


def _untrusted() -> Column:
    return _issue(
        "UNTRUSTED_TEXT_IN_DESCRIPTION", F.lit("description"), F.col("text"),
        _text("Description addresses an automated classifier (patterns: ",
              F.array_join("guard_hits", "; "),
              "). Text rules are off for this record and a person has to look at it."),
    )


def untrusted_issues(guarded: DataFrame, detected_at: datetime | None = None) -> DataFrame:
    """UNTRUSTED_TEXT_IN_DESCRIPTION for rows whose guard found something."""
    return guarded.where(F.size("guard_hits") > 0).select(
        *RECORD_KEY, "source_record_id", F.inline(F.array(_untrusted()))).withColumn(
        "detected_at", F.lit(detected_at).cast("timestamp")).select(*ISSUE_COLUMNS)


def assumed_rates_issue(spark: SparkSession, about: dict, detected_at: datetime | None = None) -> DataFrame:
    """FX_ASSUMED_RATES: one entry for the whole ledger unless the rates are authoritative."""
    base = spark.range(1).select(F.lit(None).cast("string").alias("country_code"),
                                 F.lit(None).cast("string").alias("batch_id"))
    if about.get("authoritative"):
        base = base.where(F.lit(False))
    return batch_issues(
        base, "FX_ASSUMED_RATES", F.lit(None), F.lit(None).cast("string"),
        _text("USD figures rest on assumed rates (", F.lit(str(about.get("rate_source"))), ", ",
              F.lit(str(about.get("period"))), "); indicative until official rates replace them."),
        detected_at,
    )


def register(*parts: DataFrame) -> DataFrame:
    """One register from many rule outputs."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
