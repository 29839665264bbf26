"""Report grids: banner, header, data rows, printed total.

Input is an extracted grid ``(source_file, source_sheet, row_no, cells)``; cells are text,
or variants where the extraction keeps native numbers.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..functions.text import strip
from ..operators.joins import salted_lookup
from ..operators.landing import stage

_SHEET = ("source_file", "source_sheet")


def _cell_text(grid: DataFrame) -> Column:
    """Cells as stripped text, empty for NULL."""
    is_variant = grid.schema["cells"].dataType.simpleString() == "array<variant>"

    def read(c: Column) -> Column:
        text = F.try_variant_get(c, "$", "string") if is_variant else c
        return F.coalesce(strip(text), F.lit(""))

    return F.transform("cells", read)


def find_headers(grid: DataFrame, spec: SourceSpec) -> DataFrame:
    """Header row per sheet: the configured row if it looks like one, else the first that does.

    A row is a header when it holds at least half of the mapped column names, two at least.
    """
    expected = sorted({str(v).strip().lower() for v in spec.field_map.values()})
    enough = max(2, len(expected) // 2)
    known = F.size(F.array_intersect(
        F.array_distinct(F.transform("_texts", F.lower)), F.array(*[F.lit(e) for e in expected])))
    candidates = (
        grid.withColumn("_texts", _cell_text(grid))
        .where(known >= enough)
    )
    preferred = F.struct((F.col("row_no") != spec.header_row).alias("scanned"), F.col("row_no").alias("at"))
    return candidates.groupBy(*_SHEET).agg(
        F.min_by(F.struct("row_no", "_texts"), preferred).alias("_h")
    ).select(*_SHEET, F.col("_h.row_no").alias("header_row"), F.col("_h._texts").alias("header"))


def missing_headers(grid: DataFrame, spec: SourceSpec) -> DataFrame:
    """Sheets in which no header row was found; a load must not go on with these."""
    return grid.select(*_SHEET).distinct().join(find_headers(grid, spec), list(_SHEET), "left_anti")


def grid_records(grid: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """(data records, printed total rows), both as ``source_file, source_sheet, row_no, payload``.

    Blank rows are dropped; a row whose first cell is the total marker is a control
    figure and never data.
    """
    headers = find_headers(grid, spec)
    body = salted_lookup(
        grid.withColumn("_texts", _cell_text(grid)), headers, _SHEET, ["row_no"], how="inner"
    ).where(F.col("row_no") > F.col("header_row")).where(F.exists("_texts", lambda c: c != ""))
    named = F.filter(
        F.arrays_zip(F.col("header").alias("name"), F.col("cells").alias("cell")),
        lambda p: F.coalesce(p["name"], F.lit("")) != "",
    )
    paired = F.map_from_entries(F.transform(
        F.filter(named, lambda p: p["name"].isNotNull()), lambda p: F.struct(p["name"], p["cell"])))
    marker = (spec.total_row_marker or "").strip().upper()
    is_total = (F.upper(F.element_at("_texts", 1)) == marker) if marker else F.lit(False)
    records = body.select(*_SHEET, "row_no", F.to_json(paired, {"ignoreNullFields": "false"}).alias("payload"),
                          F.coalesce(is_total, F.lit(False)).alias("_total"))
    return records.where(~F.col("_total")).drop("_total"), records.where("_total").drop("_total")


def chart_of_accounts(grid: DataFrame, spec: SourceSpec) -> DataFrame:
    """``country_code, account_code, label, row_no`` from a chart sheet.

    Columns are found by name in the first row, else the first two are taken; rows
    without a code are skipped.
    """
    texts = grid.where(F.col("source_sheet") == spec.chart_sheet).withColumn("_texts", _cell_text(grid))
    head = texts.groupBy(*_SHEET).agg(F.min_by(F.struct("row_no", "_texts"), "row_no").alias("_h"))
    code_at = F.array_position(F.col("_h._texts"), spec.chart_code_column or "")
    label_at = F.array_position(F.col("_h._texts"), spec.chart_label_column or "")
    named = (code_at > 0) & (label_at > 0)
    columns = head.select(
        *_SHEET, F.col("_h.row_no").alias("_first"),
        F.when(named, code_at).otherwise(1).cast("int").alias("_code_at"),
        F.when(named, label_at).otherwise(2).cast("int").alias("_label_at"),
    )
    rows = texts.join(columns, list(_SHEET)).where(F.col("row_no") > F.col("_first"))
    code = F.try_element_at("_texts", F.col("_code_at"))
    return rows.select(
        F.lit(spec.country_code).alias("country_code"),
        F.nullif(code, F.lit("")).alias("account_code"),
        F.nullif(F.try_element_at("_texts", F.col("_label_at")), F.lit("")).alias("label"),
        "row_no",
    ).where("account_code IS NOT NULL")


def stage_grid(grid: DataFrame, spec: SourceSpec, batch_id: str, ingested_at: datetime) -> tuple[DataFrame, DataFrame]:
    """(staged data rows, printed total rows with their payload)."""
    sheet = grid if spec.sheet is None else grid.where(F.col("source_sheet") == spec.sheet)
    data, totals = grid_records(sheet, spec)
    return stage(data, spec, batch_id, ingested_at), totals
