"""Verbatim landing and projection to canonical fields."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CANONICAL_FIELDS, SourceSpec
from ..functions.text import strip

STAGED_COLUMNS = (
    "batch_id", "country_code", "source_file", "source_sheet", "row_no",
    "source_record_id", "payload", "ingested_at",
)
# A row number counts inside one sheet of one file; a source without sheets has the sheet ''.
POSITION = ("source_file", "source_sheet", "row_no")
RECORD_KEY = ("country_code", "batch_id", *POSITION, "child_pos")


def json_path(*names: str) -> str:
    """A path that treats dots and quotes in field names literally."""
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def field_text(payload: Column, name: str | None) -> Column:
    """A payload field as text; NULL when the source has no such field."""
    if not name:
        return F.lit(None).cast("string")
    return F.try_variant_get(payload, json_path(name), "string")


def stage(
    records: DataFrame,
    spec: SourceSpec,
    batch_id: str,
    ingested_at: datetime,
    payload: Column | None = None,
) -> DataFrame:
    """Land records ``(source_file, row_no, …)`` verbatim with their lineage.

    ``payload`` is the untouched record as JSON text; by default it is built from the
    column ``payload`` when present, else from every column but the position columns.
    """
    position = set(POSITION)
    if payload is None:
        payload = (
            F.col("payload").cast("string") if "payload" in records.columns
            else F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in position]),
                           {"ignoreNullFields": "false"})
        )
    sheet = F.col("source_sheet") if "source_sheet" in records.columns else F.lit(spec.sheet).cast("string")
    staged = records.select(
        F.lit(batch_id).alias("batch_id"),
        F.lit(spec.country_code).alias("country_code"),
        "source_file",
        F.coalesce(sheet, F.lit("")).alias("source_sheet"),
        F.col("row_no").cast("long").alias("row_no"),
        payload.alias("payload"),
    )
    record_id = strip(field_text(F.try_parse_json("payload"), spec.field_map.get("source_record_id")))
    return staged.withColumns({
        "source_record_id": record_id,
        "ingested_at": F.lit(ingested_at).cast("timestamp"),
    }).select(*STAGED_COLUMNS)


def project_canonical(staged: DataFrame, specs: Sequence[SourceSpec]) -> DataFrame:
    """Staged payloads to canonical text columns through each source's field map.

    One scan whatever the number of sources: a field whose source column differs by
    country becomes a CASE over country codes.  Native numbers are told apart from
    numeric text, because only text goes through separator inference.
    """
    doc = F.col("_doc")

    def pick(name: str, read) -> Column:
        by_column: dict[str | None, list[str]] = {}
        for s in specs:
            by_column.setdefault(s.field_map.get(name), []).append(s.country_code)
        return case_by_country({c: codes for c, codes in by_column.items()}, read)

    parsed = staged.withColumn("_doc", F.try_parse_json("payload"))
    fields = {
        name: pick(name, lambda column: field_text(doc, column))
        for name in CANONICAL_FIELDS if name not in ("source_record_id", "amount")
    }
    kind = pick("amount", lambda c: F.schema_of_variant(F.try_variant_get(doc, json_path(c), "variant"))
                if c else F.lit(None).cast("string"))
    number = pick("amount", lambda c: F.try_variant_get(doc, json_path(c), "decimal(24,6)")
                  if c else F.lit(None).cast("decimal(24,6)"))
    by_child: dict[str | None, list[str]] = {}
    for s in specs:
        by_child.setdefault(s.child_path, []).append(s.country_code)
    children = case_by_country(
        by_child,
        lambda c: F.try_variant_get(doc, json_path(c), "array<variant>") if c
        else F.lit(None).cast("array<variant>"),
    )
    return parsed.select(
        "batch_id", "country_code", "source_file", "source_sheet", "row_no", "source_record_id",
        *[expr.alias(name) for name, expr in fields.items()],
        pick("amount", lambda c: field_text(doc, c)).alias("amount"),
        kind.rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT|BOOLEAN)").alias("amount_is_number"),
        number.alias("amount_number"),
        children.alias("children"),
    )


def case_by_country(values: Mapping, build) -> Column:
    """``build(value)`` for each group of country codes, as one CASE; a single group needs none."""
    groups = list(values.items())
    if len(groups) == 1:
        return build(groups[0][0])
    chain = None
    for value, codes in groups[:-1]:
        test = F.col("country_code").isin(*codes)
        chain = F.when(test, build(value)) if chain is None else chain.when(test, build(value))
    value, codes = groups[-1]
    return chain.when(F.col("country_code").isin(*codes), build(value))


def convention(specs: Sequence[SourceSpec], attribute: str, build) -> Column:
    """A per-source convention compiled to one expression."""
    values: dict = {}
    for s in specs:
        key = getattr(s, attribute)
        values.setdefault(tuple(key) if isinstance(key, list) else key, []).append(s.country_code)
    return case_by_country(values, build)
