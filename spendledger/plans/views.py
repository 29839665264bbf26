"""The two analyst views."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dims import with_dimensions
from ..operators.history import is_pending
from ..operators.joins import reference_lookup
from ..operators.landing import RECORD_KEY

_PIVOTED = ("code", "outcome", "method", "confidence", "needs_review", "review_status")


def pivot_schemes(current_rows: DataFrame, key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Both schemes of a record side by side, in one aggregate over the record key."""
    fields = F.struct(*_PIVOTED)
    wide = current_rows.groupBy(*key).agg(
        F.any_value(F.when(F.col("scheme") == "SHA", fields), True).alias("_sha"),
        F.any_value(F.when(F.col("scheme") == "SRHR", fields), True).alias("_srhr"),
    )
    return wide.select(
        *key,
        *[F.col(f"_sha.{c}").alias(f"sha_{c}") for c in _PIVOTED],
        *[F.col(f"_srhr.{c}").alias(f"srhr_{c}") for c in _PIVOTED],
    )


def flatten_results(classified: DataFrame) -> DataFrame:
    """The same columns straight from a classification pass, without a shuffle."""
    def status(r: str) -> Column:
        return F.when(F.col(f"{r}.needs_review"), "PENDING").otherwise("NOT_REQUIRED")

    columns = {}
    for r in ("sha", "srhr"):
        for c in _PIVOTED[:-1]:
            columns[f"{r}_{c}"] = F.col(f"{r}.{c}")
        columns[f"{r}_review_status"] = status(r)
    return classified.withColumns(columns).drop("sha", "srhr", "text", "guard_hits")


def classified_view(
    facts_with_schemes: DataFrame,
    countries: DataFrame,
    ministries: DataFrame,
    accounts: DataFrame,
    sha_labels: DataFrame,
    srhr_labels: DataFrame,
) -> DataFrame:
    """Countable records with both schemes and every label; the table behind all totals."""
    rows = facts_with_schemes.where("is_countable")
    rows = reference_lookup(rows, countries.select("country_code", "country_name"), ["country_code"], how="inner")
    rows = with_dimensions(rows, ministries, accounts)
    for name, labels in (("sha", sha_labels), ("srhr", srhr_labels)):
        described = labels.select(F.col("code").alias(f"{name}_code"),
                                  F.col("description").alias(f"{name}_description"))
        rows = reference_lookup(rows, described, [f"{name}_code"])
    return rows


#: What a person sees of a record in the queue.
SHOWN = ("source_record_id", "description", "account_code", "amount_original", "currency_original", "amount_usd")


def review_queue(current_rows: DataFrame, facts: DataFrame | None = None, accounts: DataFrame | None = None,
                 key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Everything a person still has to look at; order it by ``amount_usd`` when shown.

    Without ``facts`` the rows carry the record's columns themselves (``classification_rows(…, carry=SHOWN)``)
    and nothing is joined.
    """
    carried = SHOWN if facts is None else ()
    queue = current_rows.where(is_pending()).select(
        *key, "scheme", "code", "outcome", "method", "confidence", "explanation", "review_status", *carried)
    if facts is not None:
        queue = queue.join(facts.select(*key, *SHOWN), list(key))
    if accounts is None:
        return queue
    labels = accounts.select("country_code", "account_code", "account_label")
    return reference_lookup(queue, labels, ["country_code", "account_code"])


def sha_bucket(code: str = "sha_code", outcome: str = "sha_outcome") -> Column:
    """Outcome first: a provisional code must not hide that the function is not known."""
    return F.when(F.col(outcome) == "ADMIN_INPUT", "ADMIN_INPUT").otherwise(F.coalesce(code, outcome))


def srhr_bucket(code: str = "srhr_code", outcome: str = "srhr_outcome") -> Column:
    return F.coalesce(code, outcome)
