"""Loading a source end to end: land, harmonise, register, reconcile, classify.

A country is the unit of replacement.  Each stage is written to the warehouse and read
back, so lineage stays short and a lost executor costs one stage at most.  All tables of a
load are published together at its end; until then readers see the load before.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RuleSet, SourceSpec
from ..functions.amounts import parse_amount
from ..operators.canonical import canonicalise, variant_issues
from ..operators.classify import classification_rows, classify, run_stats
from ..operators.dims import accounts as account_dim
from ..operators.dims import CHART, canonical_labels, complete_countries
from ..operators.dims import ministries as ministry_dim
from ..operators.harmonise import FACT_COLUMNS, harmonise
from ..operators.history import SCHEME_KEY, apply_decisions, current
from ..operators.landing import POSITION, field_text, project_canonical
from ..operators.quality import (
    assumed_rates_issue, batch_issues, collision_issues, register, row_issues, untrusted_issues,
)
from ..sources.delimited import stage_delimited
from ..sources.grid import chart_of_accounts, missing_headers, stage_grid
from ..sources.json_records import source_metadata, stage_json
from ..sources.warehouse import Change, Warehouse

BATCH_SCHEMA = (
    "country_code string, batch_id string, source_file string, source_system string, started_at timestamp,"
    " rows_read long, rows_staged long, declared_records long, control_total decimal(24,6),"
    " loaded_total decimal(24,6), extracted_on date, source_metadata string"
)


@dataclass(frozen=True)
class Reference:
    """Everything a load looks up, as tables and values."""

    fx: DataFrame
    fx_about: dict
    mapping: DataFrame
    rules: RuleSet
    sha_labels: DataFrame | None = None


def control_totals(total_rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Printed totals, with their position, ``raw`` and ``control_total``, read under the source's own conventions."""
    raw = field_text(F.try_parse_json("payload"), spec.field_map.get("amount"))
    return parse_amount(
        total_rows.select(*POSITION, raw.alias("raw")), "raw",
        decimal_separator=spec.decimal_separator, suffixes=spec.strip_suffixes, into="control_total")


def last_total(totals: DataFrame, *group: str) -> DataFrame:
    """The number of printed totals and the one that stands last; a subtotal above it does not count."""
    return totals.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_totals"), F.max_by("control_total", F.struct(*POSITION)).alias("control_total"))


def control_issues(totals: DataFrame, spec: SourceSpec, batch_id: str, at: datetime) -> DataFrame:
    rows = totals.select("raw", "control_total", F.lit(spec.country_code).alias("country_code"), F.lit(batch_id).alias("batch_id"))
    return batch_issues(
        rows, "SRC_CONTROL_TOTAL", F.lit(spec.field_map.get("amount")), F.col("raw"),
        F.concat(F.lit("Source prints a control total of "), F.coalesce(F.col("control_total").cast("string"), F.lit("none")),
                 F.lit("; kept out of the records and compared after the load.")), at)


def batch_close_issues(batches: DataFrame, at: datetime | None = None) -> DataFrame:
    """Declared count and printed total against what was loaded, for any number of loads."""
    counted = batches.where(
        F.col("declared_records").isNotNull() & (F.col("declared_records") != F.col("rows_staged")))
    gap = F.round(F.col("loaded_total") - F.col("control_total"), 2)
    total = batches.where((F.col("control_total") != 0) & (F.abs(gap) > F.lit("0.5").cast("decimal(2,1)")))
    nothing: Column = F.lit(None).cast("string")
    return batch_issues(
        counted, "SRC_COUNT_MISMATCH", F.lit(None), nothing,
        F.format_string("Source declares %d records; %d were staged.", "declared_records", "rows_staged"), at,
    ).unionByName(batch_issues(
        total, "CONTROL_TOTAL_MISMATCH", F.lit(None),
        F.concat(F.lit("control="), F.col("control_total").cast("string"), F.lit(" loaded="),
                 F.col("loaded_total").cast("string")),
        F.concat(F.lit("Loaded total is off the printed total by "), gap.cast("string"),
                 F.lit("; records without a readable amount are not in the loaded sum.")), at))


def stage_source(spark: SparkSession, spec: SourceSpec, path: str, batch_id: str, at: datetime,
                 grid: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(staged rows, printed total rows or None) for any reader."""
    if spec.reader == "csv":
        return stage_delimited(spark, path, spec, batch_id, at), None
    if spec.reader in ("json", "jsonl"):
        return stage_json(spark, path, spec, batch_id, at), None
    if spec.reader in ("excel", "grid"):
        rows = grid if grid is not None else spark.read.parquet(path)
        sheet = rows if spec.sheet is None else rows.where(F.col("source_sheet") == spec.sheet)
        if missing_headers(sheet, spec).limit(1).count():
            raise ValueError(f"{path}: no header row found in sheet {spec.sheet!r}")
        return stage_grid(rows, spec, batch_id, at)
    raise ValueError(f"unknown reader {spec.reader!r}")


def load_source(
    spark: SparkSession,
    warehouse: Warehouse,
    spec: SourceSpec,
    path: str,
    reference: Reference,
    at: datetime,
    mode: str = "replace",
    grid: DataFrame | None = None,
) -> str:
    """Load one country's extract and return its batch id; a missing file raises.

    ``replace`` supersedes the country's earlier loads, ``append`` adds a load beside them.
    Classification is a step of its own (``classify_country``), so a mapping change never
    re-reads a file.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    batch_id = f"{spec.country_code}-{at:%Y%m%dT%H%M%S%f}"
    with warehouse.change(spec.country_code) as change:
        write = change.replace if mode == "replace" else change.append
        if mode == "replace":
            change.clear("classification", "decided", "guard_issues")
        staged, totals = stage_source(spark, spec, path, batch_id, at, grid)
        write("staged", staged)
        landed = change.read("staged").where(F.col("batch_id") == batch_id)

        canonical = project_canonical(landed, [spec])
        meta = None
        if spec.reader in ("json", "jsonl") and spec.metadata_path:
            # One row for each file: a record is checked against its own file's extraction day.
            by_file = source_metadata(spark, path, spec)
            canonical = canonical.join(by_file.select("source_file", "extracted_on"), "source_file", "left")
            meta = by_file.agg(
                F.sum("declared_records").alias("declared_records"), F.max("extracted_on").alias("extracted_on"),
                F.max_by("source_metadata", "source_file").alias("source_metadata")).first()
        with warehouse.step("harmonised", harmonise(canonical, [spec], reference.fx)) as harmonised:
            _finish(spark, change, spec, path, at, batch_id, write, landed, harmonised, totals, meta, grid)
        # The finding about assumed rates is one for all loads; the load published last has it.
        change.replace("rate_issues", assumed_rates_issue(spark, reference.fx_about, at).drop("country_code"))
    return batch_id


def _finish(spark, change, spec, path, at, batch_id, write, landed, harmonised, totals, meta, grid) -> None:
    """Facts, the load's figures, its findings and the dimensions, from the harmonised rows."""
    write("facts", canonicalise(harmonised.select(*FACT_COLUMNS)))
    facts = change.read("facts").where(F.col("batch_id") == batch_id)

    printed = control_totals(totals, spec) if totals is not None else None
    figures = last_total(printed).first() if printed is not None else None
    n_staged = landed.count()
    loaded = facts.where("is_countable").agg(
        F.round(F.sum("amount_original"), 2).cast("decimal(24,6)").alias("t")).first()["t"]
    batch = spark.createDataFrame([(
        spec.country_code, batch_id, path, spec.source_system, at,
        n_staged + (figures["n_totals"] if figures else 0), n_staged,
        meta["declared_records"] if meta else None, figures["control_total"] if figures else None, loaded,
        meta["extracted_on"] if meta else None, meta["source_metadata"] if meta else None,
    )], BATCH_SCHEMA)
    parts = [
        row_issues(harmonised, [spec], at),
        collision_issues(harmonised, [spec], at),
        variant_issues(harmonised, at),
        batch_close_issues(batch, at),
    ]
    if printed is not None:
        parts.append(control_issues(printed, spec, batch_id, at))
    write("issues", register(*parts))
    write("batches", batch)
    if spec.chart_sheet and spec.reader in ("excel", "grid"):
        write("charts", chart_of_accounts(grid if grid is not None else spark.read.parquet(path), spec))
    refresh_dimensions(change)


def refresh_dimensions(change: Change) -> None:
    """Grow a country's ministries and accounts from the facts its next version will have.

    A stored member stays as it is: its name changes only where it was empty, and an
    account's label only where the chart of accounts gives one.  Members never go.
    """
    facts = change.read("facts")
    chart = change.read("charts") if change.exists("charts") else None
    fresh = {
        "ministries": (ministry_dim(facts), "ministry_code", "ministry_name"),
        "accounts": (canonical_labels(account_dim(facts, chart), facts), "account_code", "account_label"),
    }
    for name, (dim, key, label) in fresh.items():
        if change.exists(name):
            dim = merge_dimension(change.read(name), dim, key, label)
        change.replace(name, dim)


def merge_dimension(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Stored members with what a load adds: new members, labels that were empty, labels of a chart."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")
    takes = F.col("o.country_code").isNull()
    if "source" in new.columns:
        takes = takes | (F.col("n.source") == CHART)
        observed = F.coalesce(F.col("o.source") != CHART, F.lit(True))
    else:
        observed = F.lit(True)
    takes = takes | (F.col("n.country_code").isNotNull() & F.col(f"o.{label}").isNull() & observed)
    takes = F.coalesce(takes, F.lit(False))
    return both.select(*[
        (F.when(takes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in (label, "source")
         else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in new.columns])


def classify_country(
    spark: SparkSession,
    warehouse: Warehouse,
    reference: Reference,
    at: datetime,
    country: str | None = None,
    preserve_manual: bool = False,
) -> DataFrame:
    """(Re-)classify one country or all; earlier results stay as history.  Returns the run's counts.

    With ``preserve_manual`` manual corrections stay current; otherwise a run supersedes
    them like any other result.
    """
    run = int(at.timestamp() * 1_000_000)
    covered = [country] if country else warehouse.countries()
    with warehouse.change(*covered) as change:
        classified = classify(change.read("facts"), reference.mapping, reference.rules, reference.sha_labels)
        with warehouse.step("classified", classified) as done:
            rows = classification_rows(done, at, run)
            if preserve_manual and change.exists("classification"):
                manual = current(change.read("classification")).where("method = 'manual'")
                rows = rows.join(manual.select(*SCHEME_KEY), list(SCHEME_KEY), "left_anti")
            change.append("classification", rows)
            # Guard findings are those of the latest run, also where it found nothing.
            change.replace("guard_issues", untrusted_issues(done, at))
            stats = run_stats(done).collect()
    return spark.createDataFrame(stats)


def record_decisions(warehouse: Warehouse, decisions: DataFrame) -> None:
    """Append what review decisions make of the pending rows; nothing else is written.

    Readers of ``classification`` see the history with the decisions merged in, until
    ``compact_history`` writes it that way.
    """
    named = {r["country_code"] for r in decisions.select("country_code").distinct().collect()}  # one row a country
    touched = [c for c in warehouse.countries() if c in named]
    if not touched:
        return
    with warehouse.change(*touched) as change:
        change.append("decided", apply_decisions(current(change.read("classification")), decisions))


def compact_history(warehouse: Warehouse, *countries: str) -> None:
    """Write the history of some countries (all, if none is named) with its decisions merged in."""
    with warehouse.change(*(countries or warehouse.countries())) as change:
        change.replace("classification", change.read("classification"))
        change.clear("decided")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a source can be listed; any file system Spark reads."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
        return True
    except AnalysisException:
        return False


def build(
    spark: SparkSession,
    warehouse: Warehouse,
    specs: dict[str, SourceSpec],
    data_dir: str,
    countries: DataFrame,
    reference: Reference,
    at: datetime,
    grids: dict[str, DataFrame] | None = None,
) -> dict:
    """Load every source, classify once, and say which sources were missing and skipped."""
    known = spark.createDataFrame(
        [(c, s.name, s.currency, s.language) for c, s in specs.items()],
        "country_code string, name string, currency string, language string")
    warehouse.rewrite("countries", complete_countries(countries, known))
    loaded, skipped = {}, []
    for code, spec in specs.items():
        path = f"{data_dir.rstrip('/')}/{spec.path}"
        grid = (grids or {}).get(code)
        if grid is None and not path_exists(spark, path):
            skipped.append(code)
            continue
        loaded[code] = load_source(spark, warehouse, spec, path, reference, at, grid=grid)
    if loaded:
        stats = classify_country(spark, warehouse, reference, at).first().asDict()
    else:
        stats = {}
    return {"loaded": loaded, "skipped": skipped, "classification": stats}
