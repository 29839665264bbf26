"""The named reports.

Inputs follow the warehouse tables: ``facts`` (all records), ``view`` (``flatten_results``
or ``pivot_schemes`` joined to facts), ``current_rows`` (one row per record and scheme),
``issues`` (the register), ``batches``.  Money is summed as decimals and becomes a double
only at the report's edge.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case
from ..operators.history import is_pending
from ..operators.landing import POSITION, RECORD_KEY
from ..session import stored
from .views import sha_bucket, srhr_bucket


def money(total: Column) -> Column:
    return total.cast("double")


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "ERROR", 1).when(F.col(column) == "WARN", 2).otherwise(3)


def headline(view: DataFrame | None, all_classified: DataFrame, issues: DataFrame) -> DataFrame:
    """Headline figures as ``metric, value`` rows.

    ``view``: countable records, None: those of ``all_classified``, counted in one pass with the rest;
    ``all_classified``: every record with its schemes flat.
    """
    counted = F.col("is_countable") if view is None else F.lit(True)
    totals = (
        F.count_if(counted).cast("double").alias("countable_records"),
        money(F.sum(F.when(counted, F.col("amount_usd")))).alias("total_usd"),
        F.count_distinct(F.when(counted, F.col("country_code"))).cast("double").alias("countries"),
    )
    graded = (
        F.count(F.lit(1)).cast("double").alias("classifications"),
        F.count_if(F.col("sha_outcome") == "CLASSIFIED").cast("double").alias("sha_classified"),
        F.count_if(F.col("sha_needs_review") & (F.col("sha_review_status") == "PENDING")).cast("double")
        .alias("awaiting_review"),
    )
    found = issues.agg(
        F.count_if(F.col("severity") == "ERROR").cast("double").alias("dq_errors"),
        F.count_if(F.col("severity") == "WARN").cast("double").alias("dq_warnings"),
    )
    found = stored(found, "found")  # by a job of its own: the register's shuffles are gone before the records are shuffled

    def long(wide: DataFrame) -> DataFrame:
        return wide.unpivot([], wide.columns, "metric", "value")

    if view is None:
        return long(all_classified.agg(*totals, *graded)).unionByName(long(found))
    return long(view.agg(*totals)).unionByName(long(all_classified.agg(*graded))).unionByName(long(found))


def by_country(facts: DataFrame | None, countries: DataFrame, all_classified: DataFrame, issues: DataFrame) -> DataFrame:
    """Countable totals per country, records awaiting review in either scheme, and errors.

    Without ``facts`` the classified records carry the amounts themselves, and one pass gives both.
    """
    counted = F.col("is_countable")
    amounts = (
        F.count_if(counted).alias("records"),
        money(F.sum(F.when(counted, F.col("amount_original")))).alias("total_local"),
        money(F.sum(F.when(counted, F.col("amount_usd")))).alias("total_usd"),
    )
    pending = (F.col("sha_needs_review") & (F.col("sha_review_status") == "PENDING")) | (
        F.col("srhr_needs_review") & (F.col("srhr_review_status") == "PENDING"))
    waiting = F.count_if(pending).alias("awaiting_review")
    if facts is None:
        totals = all_classified.groupBy("country_code").agg(*amounts, waiting).where("records > 0")
    else:
        totals = facts.where(counted).groupBy("country_code").agg(*amounts).join(
            all_classified.groupBy("country_code").agg(waiting), "country_code", "left")
    errors = issues.where("severity = 'ERROR'").groupBy("country_code").agg(F.count(F.lit(1)).alias("dq_errors"))
    errors = stored(errors, "errors")  # by a job of its own: the register's shuffles are gone before the records are shuffled
    return (
        totals.join(countries.select("country_code", "country_name", F.col("primary_currency").alias("currency")),
                    "country_code")
        .join(errors, "country_code", "left")
        .select("country_code", "country_name", "currency", "records", "total_local", "total_usd",
                F.coalesce("awaiting_review", F.lit(0)).alias("awaiting_review"),
                F.coalesce("dq_errors", F.lit(0)).alias("dq_errors"))
    )


def _by_bucket(view: DataFrame, name: str, bucket: Column, labels: DataFrame, description: Column) -> DataFrame:
    """Reduce to (bucket, code, outcome) first; labels join to a handful of rows."""
    code, outcome = f"{name}_code", f"{name}_outcome"
    reduced = view.groupBy(bucket.alias(name), F.col(code), F.col(outcome)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("usd"))
    labelled = reduced.join(
        labels.select(F.col("code").alias(code), F.col("description").alias("_label")), code, "left")
    return labelled.groupBy(name, description.alias("description")).agg(
        F.sum("n").alias("records"), money(F.sum("usd")).alias("total_usd"))


def by_sha(view: DataFrame, labels: DataFrame) -> DataFrame:
    description = F.when(
        F.col("sha_outcome") == "ADMIN_INPUT", "Cost of inputs; function unknown, HC.7 for now"
    ).otherwise(F.coalesce("_label", "sha_outcome"))
    return _by_bucket(view, "sha", sha_bucket(), labels, description)


def by_srhr(view: DataFrame, labels: DataFrame) -> DataFrame:
    return _by_bucket(view, "srhr", srhr_bucket(), labels, F.coalesce("_label", "srhr_outcome"))


def srhr_by_country(view: DataFrame, outside: str = "SRHR.NA") -> DataFrame:
    """Theme totals per country, leaving out records that belong to no theme."""
    return view.where(F.col("srhr_code").isNotNull() & (F.col("srhr_code") != outside)).groupBy(
        "country_code", F.col("srhr_code").alias("srhr")).agg(
        money(F.sum("amount_usd")).alias("usd"), F.count(F.lit(1)).alias("records"))


def by_ministry(facts: DataFrame, ministries: DataFrame) -> DataFrame:
    """Totals by ministry: reduced on the code before the dimension names it.

    A record with neither code nor name belongs to no ministry.
    """
    named = F.col("ministry_code").isNotNull() | F.col("ministry_name").isNotNull()
    reduced = facts.where("is_countable").groupBy("country_code", "ministry_code", named.alias("named")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("usd"))
    names = ministries.withColumnRenamed("ministry_name", "_name").withColumn("named", F.lit(True))
    joined = reduced.alias("r").join(
        names.alias("m"), (F.col("r.country_code") == F.col("m.country_code"))
        & F.col("r.ministry_code").eqNullSafe(F.col("m.ministry_code")) & (F.col("r.named") == F.col("m.named")), "left")
    return joined.groupBy("r.country_code", F.coalesce("_name", F.lit("(not given)")).alias("ministry")).agg(
        F.sum("n").alias("records"), money(F.sum("usd")).alias("total_usd"))


def how_classified(current_rows: DataFrame) -> DataFrame:
    """Per scheme, method and outcome: records, mean grade, how many flagged."""
    grade = F.col("confidence").cast("decimal(12,6)")
    return current_rows.groupBy("scheme", "method", "outcome").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.sum(grade) / F.count("confidence"), 2).cast("double").alias("avg_confidence"),
        F.count_if("needs_review").alias("flagged"),
    )


@dataclass(frozen=True)
class RecordFilter:
    """Optional conditions of the records search; None means any."""

    country: str | None = None
    sha: str | None = None
    srhr: str | None = None
    review: str | None = None          # awaiting, not required, decided
    text: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    ministry: str | None = None


# Review choices of the records search and the statuses behind them.
REVIEW_CHOICES = {
    "awaiting": ("PENDING",),
    "not required": ("NOT_REQUIRED",),
    "decided": ("ACCEPTED", "CORRECTED"),
}


def search_records(view: DataFrame, want: RecordFilter) -> DataFrame:
    """Countable records matching every given condition."""
    tests: list[Column] = []
    if want.country:
        tests.append(F.col("country_code") == want.country)
    if want.sha:
        tests.append(sha_bucket() == want.sha)
    if want.srhr:
        tests.append(srhr_bucket() == want.srhr)
    if want.review:
        tests.append(F.col("sha_review_status").isin(*REVIEW_CHOICES[want.review]))
    if want.text and want.text.strip():
        hit = None
        for column in ("description", "supplier", "account_code", "account_label"):
            if column in view.columns:
                found = F.coalesce(contains_ignoring_case(F.col(column), want.text.strip()), F.lit(False))
                hit = found if hit is None else hit | found
        if hit is not None:
            tests.append(hit)
    if want.date_from:
        tests.append(F.col("txn_date") >= F.lit(want.date_from))
    if want.date_to:
        tests.append(F.col("txn_date") <= F.lit(want.date_to))
    if want.ministry:
        tests.append(F.col("ministry_name") == want.ministry)
    for test in tests:
        view = view.where(test)
    return view


def search_totals(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount_usd")).alias("usd"))


def largest_records(selected: DataFrame, limit: int | None = None, row_key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """All records by US dollars, NULL last, or the first ``limit``; ties by record key so a cut is reproducible.

    A whole sort draws a sample of what it sorts first: the records are shuffled once before, lest they be made twice.
    """
    if limit is None:
        selected = selected.hint("rebalance", *row_key)
    ordered = selected.orderBy(F.col("amount_usd").desc_nulls_last(), *row_key)
    return ordered if limit is None else ordered.limit(limit)


def largest_per_country(view: DataFrame, row_key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Each country's largest record (ties to the first record key), one candidate for each task, never sorted."""
    rest = [c for c in view.columns if c != "country_code"]
    rank = F.struct(F.col("amount_usd").isNull().alias("unknown"), (-F.col("amount_usd")).alias("usd"),
                    *[c for c in row_key if c != "country_code"])
    top = view.groupBy("country_code").agg(F.min_by(F.struct(*rest), rank).alias("_top"))
    return top.select("country_code", "_top.*").select(*view.columns)


def in_date_order(selected: DataFrame, row_key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """A search result as it is exported: by country and date, then by record."""
    return selected.orderBy("country_code", F.col("txn_date").asc_nulls_first(), *row_key)


def filter_values(view: DataFrame) -> DataFrame:
    """Distinct values the search offers, as ``filter_name, value``."""
    choices = F.array(
        F.struct(F.lit("country").alias("filter_name"), F.col("country_code").alias("value")),
        F.struct(F.lit("sha").alias("filter_name"), sha_bucket().alias("value")),
        F.struct(F.lit("srhr").alias("filter_name"), srhr_bucket().alias("value")),
        F.struct(F.lit("ministry").alias("filter_name"), F.col("ministry_name").alias("value")),
    )
    return view.select(F.inline(choices)).where("value IS NOT NULL").distinct()


def stage_counts(facts: DataFrame) -> DataFrame:
    """Facts, splits, countable records and loaded total of each load."""
    return facts.groupBy("country_code", "batch_id").agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(F.col("record_level") == "CHILD").alias("sub_transactions"),
        F.count_if("is_countable").alias("countable"),
        F.round(F.sum(F.when(F.col("is_countable"), F.col("amount_original"))), 2).alias("loaded_total"),
    )


def load_history(batches: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per load with its counts at each stage and the gap to the printed total.

    ``batches``: country_code, batch_id, source_file, rows_read, rows_staged, control_total.
    """
    counts = stage_counts(facts)
    loaded = F.coalesce("loaded_total", F.lit(0))
    return batches.join(counts, ["country_code", "batch_id"], "left").select(
        "batch_id", "country_code", "source_file", "rows_read", "rows_staged",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "sub_transactions", "countable")],
        F.col("control_total").cast("double").alias("control_total"),
        F.col("loaded_total").cast("double").alias("loaded_total"),
        F.when(F.col("control_total").isNotNull(), F.round(loaded - F.col("control_total"), 2)).cast("double")
        .alias("difference"),
    )


# Stages of a load in order.
FUNNEL = (("rows_read", "1 rows in file"), ("rows_staged", "2 staged"), ("facts", "3 facts"),
          ("countable", "4 countable"))


def load_funnel(history: DataFrame) -> DataFrame:
    """Record counts per stage, one row per load and stage."""
    named = history.select("country_code", "batch_id", *[F.col(c).cast("long").alias(n) for c, n in FUNNEL])
    return named.unpivot(["country_code", "batch_id"], [f"`{n}`" for _, n in FUNNEL], "stage", "records")


def label_sources(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("country_code", "source").agg(F.count(F.lit(1)).alias("accounts"))


def load_issues(issues: DataFrame, country: str, batch_id: str) -> DataFrame:
    """Rules that fired on a load, findings without a load of that country included."""
    mine = (F.col("batch_id") == batch_id) | ((F.col("country_code") == country) & F.col("batch_id").isNull())
    return issues.where(mine).groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("issues"))


def accounts_in_use(accounts: DataFrame, facts: DataFrame) -> DataFrame:
    used = facts.where("account_code IS NOT NULL").select("country_code", "account_code").distinct()
    return accounts.join(used, ["country_code", "account_code"], "left_semi")


def unmapped_in_use(accounts: DataFrame, facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Account codes the ledger uses that no mapping entry answers for."""
    return accounts_in_use(accounts, facts).join(mapping, ["country_code", "account_code"], "left_anti")


def mapping_usage(accounts: DataFrame, facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every account with its countable records and local total, and whether it is mapped."""
    used = facts.where(F.col("is_countable") & F.col("account_code").isNotNull()).groupBy(
        "country_code", "account_code").agg(F.count(F.lit(1)).alias("records"),
                                            F.sum("amount_original").alias("total_local"))
    entries = mapping.select("country_code", "account_code", F.lit(True).alias("_mapped"))
    key = ["country_code", "account_code"]
    return accounts.join(used, key, "left").join(entries, key, "left").select(
        *key, "account_label", "source", F.coalesce("records", F.lit(0)).alias("records"),
        money(F.col("total_local")).alias("total_local"),
        F.coalesce("_mapped", F.lit(False)).alias("mapped"))


def mapping_coverage(usage: DataFrame) -> DataFrame:
    """Per country: codes, mapped codes, unmapped codes and the records on them."""
    return usage.groupBy("country_code").agg(
        F.count(F.lit(1)).alias("codes"),
        F.count_if("mapped").alias("mapped_codes"),
        F.count_if(~F.col("mapped")).alias("unmapped_codes"),
        F.coalesce(F.sum(F.when(~F.col("mapped"), F.col("records"))), F.lit(0)).alias("unmapped_records"),
    )


def reference_usage(labels: DataFrame, current_rows: DataFrame, scheme: str) -> DataFrame:
    """Each code of a scheme with the number of current classifications carrying it."""
    used = current_rows.where((F.col("scheme") == scheme) & F.col("code").isNotNull()).groupBy("code").agg(
        F.count(F.lit(1)).alias("records"))
    return labels.join(used, "code", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def pending_count(current_rows: DataFrame, by: Sequence[str] = ("scheme",)) -> DataFrame:
    return current_rows.where(is_pending()).groupBy(*by).agg(F.count(F.lit(1)).alias("pending"))


def review_page(queue: DataFrame, scheme: str, country: str | None = None, limit: int | None = None,
                row_key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """The waiting records of a scheme, largest first."""
    mine = queue.where(F.col("scheme") == scheme)
    if country:
        mine = mine.where(F.col("country_code") == country)
    return largest_records(mine, limit, row_key)


def decisions_log(current_rows: DataFrame, facts: DataFrame | None = None, key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Every accept or correction still in force; newest first when shown.

    Without ``facts`` the rows carry ``source_record_id`` and ``amount_usd`` themselves and nothing is joined.
    """
    shown = ("source_record_id", "amount_usd")
    decided = current_rows.where(F.col("review_status").isin("ACCEPTED", "CORRECTED")).select(
        *key, "scheme", "code", "outcome", "method", "review_status", "reviewed_by", "reviewed_at", "review_note",
        *(shown if facts is None else ()))
    return decided if facts is None else decided.join(facts.select(*key, *shown), list(key))


def issues_by_rule(issues: DataFrame) -> DataFrame:
    """The register by rule, severity and country; ``all`` where a finding has no country."""
    return issues.groupBy(
        "rule_code", "severity", F.coalesce("country_code", F.lit("all")).alias("country_code")
    ).agg(F.count(F.lit(1)).alias("issues"))


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """Gravest first."""
    found = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_code").alias("rules"))
    return found.orderBy(severity_rank())


def issues_ranked(issues: DataFrame) -> DataFrame:
    """Rules by severity and then by number of findings, with their place from 1."""
    found = issues.groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(severity_rank(), F.desc("n"), "rule_code")  # one row for each rule
    return found.select(F.row_number().over(order).alias("place"), "rule_code", "severity", "n")


def rule_catalogue(catalogue: DataFrame, issues: DataFrame) -> DataFrame:
    """Every rule with the number of findings, zero included."""
    fired = issues.groupBy("rule_code").agg(F.count(F.lit(1)).alias("fired"))
    return catalogue.join(fired, "rule_code", "left").withColumn("fired", F.coalesce("fired", F.lit(0)))


def issue_positions(issues: DataFrame) -> DataFrame:
    """The register with the source id, file and row behind each finding, which every finding carries.

    Findings about a whole load or the whole ledger have no row and keep NULL there.
    """
    return issues.select("country_code", "batch_id", *POSITION, "child_pos", "source_record_id",
                         "rule_code", "severity", "field", "raw_value", "message", "detected_at")


def issue_detail(positions: DataFrame, rule: str, limit: int | None = None) -> DataFrame:
    """The findings of one rule in register order, or the first ``limit`` of them."""
    ordered = positions.where(F.col("rule_code") == rule).orderBy("country_code", "batch_id", *POSITION, "child_pos")
    return ordered if limit is None else ordered.limit(limit)


def staged_record(staged: DataFrame, country: str, source_record_id: str | Column) -> DataFrame:
    """The staged rows of one record: what a trace starts from where facts are not stored."""
    return staged.where((F.col("country_code") == country) & (F.col("source_record_id") == source_record_id))


def trace(facts: DataFrame, staged: DataFrame, batches: DataFrame, country: str, source_record_id: str) -> DataFrame:
    """Record to staged payload to load, for every record with the id, counted or not."""
    mine = facts.where((F.col("country_code") == country) & (F.col("source_record_id") == source_record_id))
    raw = staged.where(F.col("country_code") == country).select(
        "country_code", "batch_id", *POSITION, "payload", "ingested_at")
    loads = batches.where(F.col("country_code") == country).select("country_code", "batch_id", "source_system")
    return mine.join(raw, ["country_code", "batch_id", *POSITION]).join(loads, ["country_code", "batch_id"])


def trace_history(history: DataFrame, hits: DataFrame, key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """All classifications of the traced records, oldest first, the live one marked."""
    from ..operators.history import SCHEME_KEY, current

    mine = history.join(hits.select(*key).distinct(), list(key), "left_semi")
    live = current(mine, SCHEME_KEY).select(*SCHEME_KEY, "seq").withColumn("is_current", F.lit(True))
    return mine.join(live, [*SCHEME_KEY, "seq"], "left").withColumn(
        "is_current", F.coalesce("is_current", F.lit(False))).orderBy(*SCHEME_KEY, "seq")


def trace_children(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """Splits below the traced records, whether counted or not."""
    record = list(RECORD_KEY[:-1])
    parents = hits.where("child_pos = 0").select(*record).distinct()
    return facts.where("child_pos > 0").join(parents, record, "left_semi")


def countries_loaded(batches: DataFrame, countries: DataFrame, facts: DataFrame) -> DataFrame:
    counts = stage_counts(facts).select("country_code", "batch_id", "countable")
    return batches.join(countries.select("country_code", "country_name"), "country_code").join(
        counts, ["country_code", "batch_id"], "left").select(
        "country_code", "country_name", "batch_id", "rows_staged",
        F.coalesce("countable", F.lit(0)).alias("countable"))
