"""Currency conversion against a rate table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import reference_lookup

USD_TYPE = "decimal(24,2)"


def usd_amount(amount: Column, rate: Column) -> Column:
    """Amount in US dollars, half up at two decimals; no rate, no amount."""
    return F.when(rate != 0, F.round(amount / rate, 2)).cast(USD_TYPE)


def with_rates(
    rows: DataFrame,
    fx: DataFrame,
    currency: str = "currency_original",
) -> DataFrame:
    """Add ``_rate`` and ``_rate_source`` of each row's currency; NULL where there is none."""
    rates = fx.where("rate <> 0").select(
        F.upper("currency").alias("_ccy"), F.col("rate").alias("_rate"),
        F.col("rate_source").alias("_rate_source"))
    keyed = rows.withColumn("_ccy", F.upper(currency))
    return reference_lookup(keyed, rates, ["_ccy"]).drop("_ccy")


def apply_rates(rows: DataFrame, amount: str = "amount_original") -> DataFrame:
    """``amount_usd, fx_rate, fx_rate_source`` from the rates looked up before."""
    known = F.col(amount).isNotNull() & F.col("_rate").isNotNull()
    return rows.withColumns({
        "amount_usd": usd_amount(F.col(amount), F.col("_rate")),
        "fx_rate": F.when(known, F.col("_rate")),
        "fx_rate_source": F.when(known, F.col("_rate_source")),
    }).drop("_rate", "_rate_source")


def convert_to_usd(
    rows: DataFrame,
    fx: DataFrame,
    amount: str = "amount_original",
    currency: str = "currency_original",
) -> DataFrame:
    """Add ``amount_usd, fx_rate, fx_rate_source``; NULL where amount, currency or rate is missing."""
    return apply_rates(with_rates(rows, fx, currency), amount)
