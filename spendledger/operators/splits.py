"""Nested splits: explode, reconcile against the parent, count each split once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..functions.amounts import AMOUNT_TYPE, amount_value
from ..functions.text import normalise_text
from .joins import salted_lookup
from .landing import convention, json_path

TOLERANCE = "0.01"
SUM_TYPE = "decimal(38,6)"


def reconciles(parent: Column, children_sum: Column, all_present: Column) -> Column:
    """Parent and every child present, and the gap at most one cent."""
    gap = F.abs(children_sum - parent)
    return F.coalesce(
        parent.isNotNull() & all_present & (gap <= F.lit(TOLERANCE).cast("decimal(4,2)")), F.lit(False)
    )


def _child_amount(child: Column, spec_path: str, suffixes: Sequence[str]) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(child, spec_path, "variant"))
    text = F.try_variant_get(child, spec_path, "string")
    native = kind.rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT|BOOLEAN)")
    return F.when(native, F.try_variant_get(child, spec_path, AMOUNT_TYPE)).otherwise(
        amount_value(text, suffixes)
    )


def explode_splits(records: DataFrame, specs: Sequence[SourceSpec]) -> DataFrame:
    """Expand ``children`` below their record within the row, so no shuffle is needed.

    Children inherit date, ministry, account, currency and fiscal year.  Where they add
    up to the parent they are countable and the parent is not; otherwise the parent
    counts, the children stay visible and are marked WARN.
    """
    nested = [s for s in specs if s.child_path]
    if not nested:
        return records.drop("children").withColumn("split_sum", F.lit(None).cast(AMOUNT_TYPE)).withColumn(
            "split_reconciles", F.lit(None).cast("boolean"))

    children = F.col("children")

    def read(field: str) -> Column:
        """Array of one text field of every child, per source."""
        groups: dict[str, list[SourceSpec]] = {}
        for s in nested:
            groups.setdefault(s.child_field(field), []).append(s)
        chain = None
        for name, group in groups.items():
            test = F.col("country_code").isin(*[s.country_code for s in group])
            value = F.transform(children, lambda c: F.try_variant_get(c, json_path(name), "string"))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain

    amounts = None
    for s in nested:
        test = F.col("country_code") == s.country_code
        value = F.transform(
            children,
            lambda c: _child_amount(c, json_path(s.child_field("amount")), s.strip_suffixes),
        )
        amounts = F.when(test, value) if amounts is None else amounts.when(test, value)

    is_parent = F.coalesce(F.size(children), F.lit(0)) > 0
    prepared = records.withColumn("_amounts", F.when(is_parent, amounts)).withColumns({
        "_ids": F.when(is_parent, read("source_record_id")),
        "_texts": F.when(is_parent, read("description")),
        "_sum": F.when(is_parent, F.aggregate(
            "_amounts", F.lit(0).cast(SUM_TYPE),
            lambda acc, a: (acc + F.coalesce(a, F.lit(0).cast(AMOUNT_TYPE))).cast(SUM_TYPE),
        )),
    })
    all_present = F.forall("_amounts", lambda a: a.isNotNull())
    prepared = prepared.withColumn(
        "split_reconciles",
        F.when(is_parent, reconciles(F.col("amount_original"), F.col("_sum"), all_present)),
    )
    settled = F.coalesce(F.col("split_reconciles"), F.lit(False))
    own = F.struct(
        F.lit(0).alias("child_pos"),
        F.col("source_record_id"),
        F.when(is_parent, "PARENT").otherwise("STANDALONE").alias("record_level"),
        F.col("description"), F.col("description_raw"), F.col("supplier"), F.col("payment_method"),
        F.col("amount_original"),
        (~settled).alias("is_countable"),
        F.col("dq_status"),
    )
    below = F.transform(
        F.arrays_zip(F.col("_ids").alias("id"), F.col("_texts").alias("text"), F.col("_amounts").alias("amount")),
        lambda c, i: F.struct(
            (i + 1).alias("child_pos"),
            F.coalesce(c["id"], F.lit("")).alias("source_record_id"),
            F.lit("CHILD").alias("record_level"),
            normalise_text(c["text"]).alias("description"),
            c["text"].alias("description_raw"),
            F.lit(None).cast("string").alias("supplier"),
            F.lit(None).cast("string").alias("payment_method"),
            c["amount"].cast(AMOUNT_TYPE).alias("amount_original"),
            settled.alias("is_countable"),
            F.when(settled, "OK").otherwise("WARN").alias("dq_status"),
        ),
    )
    family = F.when(is_parent, F.concat(F.array(own), below)).otherwise(F.array(own))
    varying = ("child_pos", "source_record_id", "record_level", "description", "description_raw",
               "supplier", "payment_method", "amount_original", "is_countable", "dq_status")
    kept = [c for c in records.columns if c not in varying and c != "children"]
    return prepared.select(
        *kept,
        F.col("_sum").cast(AMOUNT_TYPE).alias("split_sum"),
        "split_reconciles",
        F.inline(family),
    )


def reconcile_splits(
    parents: DataFrame,
    children: DataFrame,
    on: Sequence[str],
    parent_amount: str,
    child_amount: str,
) -> DataFrame:
    """Splits delivered as a separate table: one verdict per parent.

    Children are summed before the shuffle; a parent with no children is STANDALONE.
    """
    sums = children.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.sum(F.col(child_amount).cast(AMOUNT_TYPE)).cast(SUM_TYPE).alias("children_sum"),
        F.bool_and(F.col(child_amount).isNotNull()).alias("_all"),
    )
    joined = salted_lookup(parents, sums, on, [*on, parent_amount])
    n = F.coalesce(F.col("n_children"), F.lit(0))
    verdict = reconciles(F.col(parent_amount).cast(AMOUNT_TYPE), F.coalesce("children_sum", F.lit(0)), F.col("_all"))
    return joined.withColumns({
        "n_children": n,
        "record_level": F.when(n > 0, "PARENT").otherwise("STANDALONE"),
        "split_reconciles": F.when(n > 0, verdict),
        "parent_countable": F.when(n > 0, ~verdict).otherwise(F.lit(True)),
        "children_countable": F.when(n > 0, verdict),
    }).drop("_all")


def counted_totals(reconciled: DataFrame, parent_amount: str) -> DataFrame:
    """Naive total (parents and children), parents only, and the total counted once."""
    parent = F.col(parent_amount).cast(SUM_TYPE)
    child = F.coalesce("children_sum", F.lit(0)).cast(SUM_TYPE)
    return reconciled.agg(
        F.sum(parent + child).alias("naive_total"),
        F.sum(parent).alias("parents_only"),
        F.sum(F.when(F.col("parent_countable"), parent).otherwise(child)).alias("counted_once"),
        F.count_if(~F.coalesce("split_reconciles", F.lit(True))).alias("mismatched_splits"),
    )
