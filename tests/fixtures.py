"""Extracts for the end-to-end tests: a delimited one made by rule, a nested one and a grid by hand."""
from datetime import date

from spendledger.config import SourceSpec

#: The delimited extract is made by the rules below, and so is what the tests expect of it.
N_ROWS = 17
SUBJECTS = ("Chairs for schools", "Eye screening of pupils", "Wells and pumps", "Youth theatre", "Street lamps")
OFFICES = (("K", "Schools"), ("L", "Waterworks"), ("M", "Streets"))


def record(k: int) -> dict:
    """Record ``k`` of the extract (row ``k + 2`` of the file), with its defects."""
    subject = SUBJECTS[k % 5]
    cents = 104_729 * (k + 3) % 9_000_000 + 7
    code, office = OFFICES[k % 3]
    return {
        "id": f"E/{4 if k in (12, 16) else k:04d}",
        "day": None if k == 14 else date(2021 if k == 9 else 2019, k % 12 + 1, k + 1),
        "office": code, "office_name": office, "account": f"A{k % 5}",
        "subject": None if k == 7 else subject.upper() if k == 11 else subject,
        "spelling": None if k == 7 else subject,
        "cents": None if k % 8 == 5 else -cents if k % 8 == 3 else cents,
    }


def line(k: int) -> str:
    r = record(k)
    amount = "" if r["cents"] is None else f"{r['cents'] / 100:,.2f} XXX"
    day = "soon" if r["day"] is None else f"{r['day']:%Y/%m/%d}"
    return "|".join((amount, r["id"], day, r["account"], r["subject"] or "", r["office"], r["office_name"], f"Firm {k % 4}"))


ROWS = "sum|ref|on|chapter|what|office|office_name|firm\n" + "".join(line(k) + "\n" for k in range(N_ROWS))
#: Findings of one load of the extract.
FOUND = {
    "AMOUNT_MISSING": sum(record(k)["cents"] is None for k in range(N_ROWS)),
    "AMOUNT_NEGATIVE": sum((record(k)["cents"] or 0) < 0 for k in range(N_ROWS)),
    "DATE_OUT_OF_PERIOD": sum(r["day"] is not None and r["day"].year != 2019 for r in map(record, range(N_ROWS))),
    "DATE_UNPARSEABLE": sum(record(k)["day"] is None for k in range(N_ROWS)),
    "DESCRIPTION_MISSING": sum(record(k)["subject"] is None for k in range(N_ROWS)),
    "SOURCE_ID_COLLISION": N_ROWS - len({record(k)["id"] for k in range(N_ROWS)}),
    "DESCRIPTION_CASE_VARIANTS": 1,
}

CSV_SPEC = SourceSpec(
    "CTX", name="Pipe country", reader="csv", path="fixture.csv", delimiter="|", currency="XXX",
    language="en", fiscal_year="2019", period_start=date(2019, 1, 1), period_end=date(2019, 12, 31),
    field_map={
        "source_record_id": "ref", "txn_date": "on", "ministry_code": "office",
        "ministry_name": "office_name", "account_code": "chapter", "description": "what",
        "supplier": "firm", "amount": "sum"},
    date_formats=("%Y/%m/%d",), decimal_separator=".", strip_suffixes=("XXX",),
)

JSON_SPEC = SourceSpec(
    "CTJ", name="Nested country", reader="json", path="nested.json", records_path="body.entries",
    metadata_path="about", metadata_extracted_at="takenAt", currency="RWF",
    period_start=date(2023, 7, 1), period_end=date(2024, 6, 30), date_formats=("%Y-%m-%d",),
    child_path="parts",
    child_field_map={"source_record_id": "partNo", "description": "purpose", "amount": "value"},
    field_map={
        "source_record_id": "entryNo", "txn_date": "bookedOn", "fiscal_year": "year",
        "ministry_code": "unit", "ministry_name": "unitName", "account_code": "line",
        "description": "purpose", "supplier": "paidTo", "amount": "value", "currency": "ccy"},
)

NESTED = {
    "about": {"recordCount": 7, "takenAt": "2024-05-15T09:22:41Z"},
    "body": {"entries": [
        {"entryNo": "A", "bookedOn": "2023-08-01", "value": 100.00, "ccy": "usd", "line": "1",
         "purpose": "Clinic works", "parts": [
             {"partNo": "A1", "purpose": "Part one", "value": 60},
             {"partNo": "A2", "purpose": "Part two", "value": "40.00"}]},
        {"entryNo": "B", "bookedOn": "2023-08-02", "value": 100.00, "line": "1", "purpose": "Split",
         "parts": [{"partNo": "B1", "value": 60.0}, {"partNo": "B2", "value": 30.0}]},
        {"entryNo": "C", "bookedOn": "2023-08-03", "value": 50, "line": 2,
         "parts": [{"partNo": "C1", "value": None}, {"value": 50}]},
        {"entryNo": "D", "bookedOn": "2024-06-01", "value": None, "line": "2",
         "parts": [{"partNo": "D1", "value": 10}]},
        {"entryNo": "E", "bookedOn": "2023-09-01", "value": 1.234, "ccy": "GHS", "line": None,
         "purpose": " ", "parts": []},
        {"entryNo": "F", "bookedOn": "2023-09-31", "value": "1.234", "line": "3", "purpose": "x"},
        {"entryNo": "G", "bookedOn": "2023-10-01", "value": 10.005, "line": "3", "purpose": "X",
         "parts": [{"partNo": "G1", "value": 10.015}]},
    ]},
}

GRID_SPEC = SourceSpec(
    "CTG", name="Grid country", reader="grid", path="grid", sheet="Depenses", header_row=7,
    total_row_marker="TOTAL", currency="XOF", language="fr", period_start=date(2023, 10, 1),
    period_end=date(2024, 9, 30), chart_sheet="Plan", chart_code_column="ligne",
    chart_label_column="intitule", date_formats=("%d-%m-%Y",), decimal_separator=",",
    strip_suffixes=("FCFA", "XOF", "F CFA"),
    field_map={
        "source_record_id": "numero", "txn_date": "jour", "ministry_code": "unite",
        "ministry_name": "unite_nom", "account_code": "ligne", "description": "objet",
        "supplier": "beneficiaire", "amount": "montant"},
)

HEADER = ["numero", "jour", "unite", "unite_nom", "ligne", "objet", "beneficiaire", "montant"]
GRID = [
    ("g.xlsx", "Depenses", 1, ["Rapport", None, None, None, None, None, None, None]),
    ("g.xlsx", "Depenses", 2, [None] * 8),
    ("g.xlsx", "Depenses", 4, HEADER),
    ("g.xlsx", "Depenses", 5, ["B1", "10-06-2024", "MS", "Sante", "610", "Santé maternelle", "T", "31,073,710 FCFA"]),
    ("g.xlsx", "Depenses", 6, ["B2", "11-06-2024", "MS", "Sante", "610", "SANTE MATERNELLE", "T", "11548910,00"]),
    ("g.xlsx", "Depenses", 7, ["B3", "12-06-2024", None, None, "611", "Vaccins", "T", "781,311 FCFA"]),
    ("g.xlsx", "Depenses", 8, [None, "", "  ", None, None, None, None, None]),
    ("g.xlsx", "Depenses", 9, ["B4", "13-06-2024", None, "Autre", "612", "Santé maternelle", "T", "3 246 565 F CFA"]),
    ("g.xlsx", "Depenses", 10, [" total ", None, None, None, None, None, None, "46 650 496"]),
    ("g.xlsx", "Plan", 1, ["intitule", "ligne"]),
    ("g.xlsx", "Plan", 2, ["Services de santé", "610"]),
    ("g.xlsx", "Plan", 3, [None, "611"]),
    ("g.xlsx", "Plan", 4, ["Sans code", None]),
]
