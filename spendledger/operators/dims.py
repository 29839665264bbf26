"""Dimensions grown from the ledger, and reference lists with overrides laid over them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, strip
from .canonical import canonical_spellings, spelling_counts
from .joins import reference_lookup
from .landing import POSITION

CHART, OBSERVED = "country_chart_of_accounts", "observed_in_extract"
_ORDER = ("batch_id", *POSITION, "child_pos")


def ministries(facts: DataFrame, order: Sequence[str] = _ORDER) -> DataFrame:
    """One row per (country, ministry code), NULL code included; the first-seen name stays."""
    named = facts.where(F.col("ministry_code").isNotNull() | F.col("ministry_name").isNotNull())
    return named.groupBy("country_code", "ministry_code").agg(
        F.min_by("ministry_name", F.struct(*order)).alias("ministry_name"))


def accounts(
    facts: DataFrame,
    chart: DataFrame | None = None,
    order: Sequence[str] = _ORDER,
) -> DataFrame:
    """One row per (country, account code) with a label and where it came from.

    A chart of accounts is authoritative even where its label is empty; otherwise the
    first description that is not NULL.  ``chart``: country_code, account_code, label, row_no.
    """
    position = F.struct(*order)
    observed = (
        facts.where(F.col("account_code").isNotNull())
        .groupBy("country_code", "account_code")
        .agg(F.min_by("description", F.when(F.col("description").isNotNull(), position)).alias("_observed"))
    )
    if chart is None:
        return observed.select("country_code", "account_code", F.col("_observed").alias("account_label"),
                               F.lit(OBSERVED).alias("source"))
    supplied = (
        chart.select("country_code", strip(F.col("account_code")).alias("account_code"),
                     strip(F.col("label")).alias("label"), "row_no")
        .where(F.col("account_code").isNotNull() & (F.col("account_code") != ""))
        .groupBy("country_code", "account_code")
        .agg(F.max_by("label", "row_no").alias("_supplied"), F.lit(True).alias("_in_chart"))
    )
    return observed.join(supplied, ["country_code", "account_code"], "full").select(
        "country_code", "account_code",
        F.when(F.col("_in_chart"), F.col("_supplied")).otherwise(F.col("_observed")).alias("account_label"),
        F.when(F.col("_in_chart"), F.lit(CHART)).otherwise(F.lit(OBSERVED)).alias("source"),
    )


def canonical_labels(accounts_dim: DataFrame, facts: DataFrame) -> DataFrame:
    """Observed labels follow the country's canonical spelling of the same text."""
    chosen = canonical_spellings(
        spelling_counts(facts, ["country_code"], "description", _ORDER), ["country_code"]
    ).select("country_code", "fold_key", "canonical")
    keyed = accounts_dim.withColumn("fold_key", fold(F.col("account_label")))
    joined = keyed.join(chosen, ["country_code", "fold_key"], "left")
    follow = (F.col("source") == OBSERVED) & F.col("canonical").isNotNull()
    return joined.select(
        "country_code", "account_code",
        F.when(follow, F.col("canonical")).otherwise(F.col("account_label")).alias("account_label"),
        "source",
    )


def complete_countries(countries: DataFrame, sources: DataFrame) -> DataFrame:
    """Insert countries that only the source list knows; existing rows are left alone.

    ``sources``: country_code, name, currency, language.
    """
    missing = sources.join(countries, "country_code", "left_anti").select(
        "country_code",
        F.coalesce(F.nullif("name", F.lit("")), "country_code").alias("country_name"),
        F.coalesce("currency", F.lit("")).alias("primary_currency"),
        "language",
    )
    return countries.select("country_code", "country_name", "primary_currency", "language").unionByName(missing)


def override_scheme(supplied: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lay additions and edits over a supplied list ``(code, description, notes)``.

    ``source`` says supplied, edited or added.  An override replaces description and
    notes as a whole.
    """
    base = supplied.select("code", F.col("description").alias("_d"), F.nullif("notes", F.lit("")).alias("_n"),
                           F.lit(True).alias("_in_base"))
    edit = overrides.select("code", F.coalesce("description", F.lit("")).alias("_ed"),
                            F.nullif("notes", F.lit("")).alias("_en"), F.lit(True).alias("_in_edit"))
    edited = F.col("_in_edit").isNotNull()
    return base.join(edit, "code", "full").select(
        "code",
        F.when(edited, F.col("_ed")).otherwise(F.col("_d")).alias("description"),
        F.when(edited, F.col("_en")).otherwise(F.col("_n")).alias("notes"),
        F.when(edited & F.col("_in_base").isNotNull(), "edited")
        .when(edited, "added").otherwise("supplied").alias("source"),
    )


def override_countries(countries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Upsert countries ``(country_code, name, currency, language)``; codes and currencies upper-cased."""
    edit = overrides.select(
        F.upper("country_code").alias("country_code"),
        F.coalesce(F.nullif("name", F.lit("")), "country_code").alias("_name"),
        F.upper(F.coalesce("currency", F.lit(""))).alias("_ccy"),
        F.col("language").alias("_lang"),
        F.lit(True).alias("_edit"),
    )
    edited = F.col("_edit").isNotNull()
    return countries.join(edit, "country_code", "full").select(
        "country_code",
        F.when(edited, F.col("_name")).otherwise(F.col("country_name")).alias("country_name"),
        F.when(edited, F.col("_ccy")).otherwise(F.col("primary_currency")).alias("primary_currency"),
        F.when(edited, F.col("_lang")).otherwise(F.col("language")).alias("language"),
    )


def with_dimensions(facts: DataFrame, ministries_dim: DataFrame, accounts_dim: DataFrame) -> DataFrame:
    """Replace the names given on the rows by the dimensions' names (NULL codes match each other)."""
    ministry = ministries_dim.select(
        "country_code", F.coalesce("ministry_code", F.lit("\x00")).alias("_ministry"),
        F.col("ministry_name").alias("_ministry_name"))
    account = accounts_dim.select("country_code", "account_code", "account_label")
    named = F.col("ministry_code").isNotNull() | F.col("ministry_name").isNotNull()
    rows = facts.withColumn("_ministry", F.when(named, F.coalesce("ministry_code", F.lit("\x00"))))
    rows = reference_lookup(rows, ministry, ["country_code", "_ministry"])
    rows = rows.withColumn("ministry_name", F.col("_ministry_name")).drop("_ministry", "_ministry_name")
    return reference_lookup(rows, account, ["country_code", "account_code"])
