"""Canonical text records to typed, countable facts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..functions.amounts import AMOUNT_TYPE, compact, parse_amount
from ..functions.dates import date_problem, day_part, declared_date, iso_date
from ..functions.text import clean_code, normalise_text, strip
from .currency import apply_rates, with_rates
from .landing import RECORD_KEY, convention
from .splits import explode_splits

FACT_COLUMNS = (
    *RECORD_KEY, "source_record_id", "record_level", "txn_date",
    "fiscal_year", "ministry_code", "ministry_name", "account_code", "description",
    "description_raw", "supplier", "payment_method", "amount_original", "currency_original",
    "amount_usd", "fx_rate", "fx_rate_source", "is_countable", "dq_status",
)


def _literal(value) -> Column:
    return F.lit(value)


def harmonise(
    canonical: DataFrame,
    specs: Sequence[SourceSpec],
    fx: DataFrame,
) -> DataFrame:
    """Parse, convert and expand canonical records of any number of sources in one pass.

    Input: the columns of ``project_canonical`` (``amount_is_number``, ``amount_number``,
    ``children`` and ``extracted_on`` may be absent).  Output: the fact columns plus the
    raw values and verdicts the quality rules read.  Nothing is shuffled unless the rate
    table outgrows a broadcast.
    """
    has = set(canonical.columns)
    default_currency = convention(specs, "currency", _literal).cast("string")
    default_year = convention(specs, "fiscal_year", _literal).cast("string")
    currency = F.coalesce(F.nullif(F.col("currency"), F.lit("")), default_currency)
    optional = [c for c in ("amount_number", "amount_is_number", "children", "extracted_on") if c in has]
    # Texts first, then the rate lookup, then amounts and dates: each group of expressions
    # stays in a generated method of its own that the JVM still compiles.
    texts = canonical.select(
        "country_code", "batch_id", "row_no", "source_file", F.coalesce("source_sheet", F.lit("")).alias("source_sheet"),
        "source_record_id",
        F.coalesce(normalise_text(F.col("fiscal_year")), default_year).alias("fiscal_year"),
        clean_code(F.col("ministry_code")).alias("ministry_code"),
        normalise_text(F.col("ministry_name")).alias("ministry_name"),
        F.nullif(strip(F.col("account_code")), F.lit("")).alias("account_code"),
        normalise_text(F.col("description")).alias("description"),
        F.col("description").alias("description_raw"),
        normalise_text(F.col("supplier")).alias("supplier"),
        clean_code(F.col("payment_method")).alias("payment_method"),
        F.nullif(F.upper(currency), F.lit("")).alias("currency_original"),
        F.col("amount").alias("amount_raw"),
        F.col("txn_date").alias("date_raw"),
        *optional,
    )
    rated = with_rates(texts, fx)

    raw_amount, raw_day = F.col("amount_raw"), F.col("date_raw")
    parsed = parse_amount(
        rated,
        "amount_raw",
        decimal_separator=convention(specs, "decimal_separator", _literal),
        compacted=convention(specs, "strip_suffixes", lambda s: compact(raw_amount, s)),
        number="amount_number" if "amount_number" in has else None,
        is_number="amount_is_number" if "amount_number" in has else None,
        into="amount_original",
    )
    text = F.col("_day_text")
    parsed = parsed.withColumn("_day_text", day_part(raw_day)).withColumn("_day", F.coalesce(
        convention(specs, "date_formats", lambda formats: declared_date(text, formats)), iso_date(text)))
    start = convention(specs, "period_start", _literal).cast("date")
    end = convention(specs, "period_end", _literal).cast("date")
    extracted = F.col("extracted_on") if "extracted_on" in has else F.lit(None).cast("date")
    outside = F.coalesce(F.col("_day") < start, F.lit(False)) | F.coalesce(F.col("_day") > end, F.lit(False))
    after = F.coalesce(F.col("_day") > extracted, F.lit(False))

    typed = parsed.select(
        "country_code", "batch_id", "row_no", F.lit(0).alias("child_pos"),
        "source_file", "source_sheet", "source_record_id",
        F.lit("STANDALONE").alias("record_level"),
        F.col("_day").alias("txn_date"),
        "fiscal_year", "ministry_code", "ministry_name", "account_code", "description", "description_raw",
        "supplier", "payment_method", "amount_original", "currency_original",
        F.lit(True).alias("is_countable"),
        "amount_raw", F.col("amount_original_problem").alias("amount_problem"),
        "date_raw", date_problem(raw_day, F.col("_day")).alias("date_problem"),
        outside.alias("outside_period"), after.alias("after_extraction"),
        start.alias("period_start"), end.alias("period_end"), extracted.alias("extracted_on"),
        "_rate", "_rate_source",
        *(["children"] if "children" in has else []),
    )
    bad_amount = F.col("amount_problem").isNotNull() & ~F.col("amount_problem").startswith("ambiguous")
    warned = bad_amount | F.col("date_problem").isNotNull() | F.col("outside_period") | F.col("after_extraction")
    typed = typed.withColumn("dq_status", F.when(warned, "WARN").otherwise("OK"))
    if "children" in has:
        typed = explode_splits(typed, specs)
    else:
        typed = typed.withColumn("split_sum", F.lit(None).cast(AMOUNT_TYPE)).withColumn(
            "split_reconciles", F.lit(None).cast("boolean"))
    return apply_rates(typed)


def facts(harmonised: DataFrame) -> DataFrame:
    """The warehouse columns of harmonised rows."""
    return harmonised.select(*FACT_COLUMNS)
