"""Configuration as values: source specs, rule sets, rates and the rule catalogue.

Configuration is small and user-written, so it is compiled into expressions or
turned into reference DataFrames; it never holds ledger rows.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from .session import values_table

# Canonical field names a source's columns are mapped to.
CANONICAL_FIELDS = (
    "source_record_id", "txn_date", "ministry_code", "ministry_name", "account_code",
    "description", "supplier", "amount", "currency", "payment_method", "fiscal_year",
)


@dataclass(frozen=True)
class SourceSpec:
    """How one source is read and which conventions its values follow."""

    country_code: str
    name: str | None = None
    reader: str = "csv"
    path: str = ""
    currency: str | None = None
    language: str | None = None
    source_system: str | None = None
    fiscal_year: str | None = None
    period_start: date | None = None
    period_end: date | None = None
    field_map: Mapping[str, str] = field(default_factory=dict)
    date_formats: Sequence[str] = ()
    decimal_separator: str = "."
    strip_suffixes: Sequence[str] = ()
    encoding: str = "UTF-8"
    delimiter: str = ","
    multiline: bool = False
    sheet: str | None = None
    header_row: int = 1
    total_row_marker: str | None = None
    chart_sheet: str | None = None
    chart_code_column: str | None = None
    chart_label_column: str | None = None
    records_path: str = ""
    metadata_path: str | None = None
    metadata_extracted_at: str | None = None
    child_path: str | None = None
    child_field_map: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, country_code: str, block: Mapping) -> "SourceSpec":
        """Build from one country's block of a sources file."""
        conventions = block.get("conventions") or {}
        period = block.get("period") or {}
        encoding = str(block.get("encoding") or "UTF-8")

        def day(value):
            return date.fromisoformat(value) if isinstance(value, str) else value

        return cls(
            country_code=country_code,
            name=block.get("name"),
            reader=block.get("reader", "csv"),
            path=block.get("path", ""),
            currency=block.get("currency"),
            language=block.get("language"),
            source_system=block.get("source_system"),
            fiscal_year=block.get("fiscal_year"),
            period_start=day(period.get("start")),
            period_end=day(period.get("end")),
            field_map=dict(block.get("field_map") or {}),
            date_formats=tuple(conventions.get("date_formats") or ()),
            decimal_separator=conventions.get("decimal_separator", "."),
            strip_suffixes=tuple(conventions.get("strip_suffixes") or ()),
            encoding="UTF-8" if encoding.lower() in ("utf-8-sig", "utf-8", "utf8") else encoding,
            delimiter=block.get("delimiter") or ",",
            multiline=bool(block.get("multiline", False)),
            sheet=block.get("sheet"),
            header_row=int(block.get("header_row", 1)),
            total_row_marker=block.get("total_row_marker"),
            chart_sheet=block.get("chart_of_accounts_sheet"),
            chart_code_column=block.get("chart_of_accounts_code_column"),
            chart_label_column=block.get("chart_of_accounts_label_column"),
            records_path=block.get("records_path") or "",
            metadata_path=block.get("metadata_path"),
            metadata_extracted_at=block.get("metadata_extracted_at"),
            child_path=block.get("child_path"),
            child_field_map=dict(block.get("child_field_map") or {}),
        )

    def child_field(self, name: str) -> str:
        defaults = {"source_record_id": "subId", "description": "description", "amount": "amount"}
        return self.child_field_map.get(name, defaults[name])


@dataclass(frozen=True)
class Rule:
    """One text rule; the first rule of a scheme that matches wins."""

    id: str
    pattern: str
    code: str | None = None
    outcome: str = "CLASSIFIED"
    confidence: float | None = None
    note: str | None = None


@dataclass(frozen=True)
class RuleSet:
    """Text rules of both schemes, guard patterns and thresholds."""

    sha: Sequence[Rule] = ()
    srhr: Sequence[Rule] = ()
    guard: Sequence[str] = ()
    review_below: float = 0.70
    default_confidence: float = 0.70
    fuzzy_threshold: float = 88.0
    fuzzy_confidence: float = 0.55
    untrusted_cap: float = 0.40

    @classmethod
    def from_mapping(cls, block: Mapping) -> "RuleSet":
        """Build from a rules file: settings, sha_rules, srhr_rules, injection_patterns."""
        settings = block.get("settings") or {}

        def rules(key: str, code_key: str) -> tuple[Rule, ...]:
            return tuple(
                Rule(
                    id=r["id"], pattern=r["pattern"], code=r.get(code_key),
                    outcome=r.get("outcome", "CLASSIFIED"), confidence=r.get("confidence"),
                    note=r.get("note"),
                )
                for r in block.get(key) or ()
            )

        return cls(
            sha=rules("sha_rules", "sha"),
            srhr=rules("srhr_rules", "srhr"),
            guard=tuple(block.get("injection_patterns") or ()),
            review_below=float(settings.get("review_below", 0.70)),
            default_confidence=float(settings.get("default_confidence", 0.70)),
            fuzzy_threshold=float(settings.get("fuzzy_threshold", 88)),
            fuzzy_confidence=float(settings.get("fuzzy_confidence", 0.55)),
        )

    @classmethod
    def from_tables(cls, rules: DataFrame, guard: DataFrame, **settings) -> "RuleSet":
        """Build from rule tables ``(scheme, position, id, pattern, code, outcome, confidence, note)``
        and ``(position, pattern)``.

        Rules are written by people and compiled into expressions, so all of them come to the driver.
        """
        rows = rules.orderBy("scheme", "position").collect()
        marks = guard.orderBy("position").collect()

        def pick(scheme: str) -> tuple[Rule, ...]:
            return tuple(
                Rule(r["id"], r["pattern"], r["code"], r["outcome"] or "CLASSIFIED", r["confidence"], r["note"])
                for r in rows if r["scheme"] == scheme
            )

        return cls(sha=pick("SHA"), srhr=pick("SRHR"), guard=tuple(m["pattern"] for m in marks), **settings)


# Default keyword rules and guard patterns.
DEFAULT_RULES = RuleSet(
    sha=(
        Rule("SHA-CAP-01", r"\b(construction|rehabilitation|batiment|building)\b", None, "CAPITAL",
             note="Building work, an investment."),
        Rule("SHA-CAP-02", r"\b(ambulance|ambulances|vehicule|vehicles?)\b", None, "CAPITAL",
             note="Buys a vehicle, an investment."),
        Rule("SHA-06.2-01", r"\b(immunisation|immunization|vaccination)\b.*\b(outreach|campaign|programme|program)\b", "HC.6.2"),
        Rule("SHA-06.3-01", r"\b(screening|depistage)\b", "HC.6.3"),
        Rule("SHA-06.4-01", r"\b(antenatal|anc|prenatal|postnatal)\b", "HC.6.4"),
        Rule("SHA-06.1-01", r"\b(sensibilisation|awareness|counselling|counseling|conseil|promotion|education)\b", "HC.6.1"),
        Rule("SHA-05.1-01", r"\b(medicament|medicine|medicines|drugs?|pharmaceutical|contraceptif|contraceptive|vaccin|vaccines?|antiretroviral|arv|kits?)\b", "HC.5.1"),
        Rule("SHA-04-01", r"\b(laboratory|laboratoire|reagent|reactif|diagnostic|transport)\b", "HC.4"),
        Rule("SHA-07-01", r"\b(cleaning|nettoyage|hygiene|fumigation|administration|salaries|salaire|traitement)\b", "HC.7"),
        Rule("SHA-01.3-01", r"\b(vbg|sgbv|gbv|survivor|victime)\b", "HC.1.3"),
    ),
    srhr=(
        Rule("SRHR-FP-01", r"\b(contraceptif|contraceptive|contraceptives|planification familiale|family planning)\b", "SRHR.FP"),
        Rule("SRHR-MH-01", r"\b(maternal|maternelle|obstetric|obstetricaux|antenatal|anc|prenatal|delivery|accouchement|maternity)\b", "SRHR.MH"),
        Rule("SRHR-NH-01", r"\b(newborn|neonatal|nouveau-ne)\b", "SRHR.NH"),
        Rule("SRHR-AH-01", r"\b(adolescent|adolescents|youth|jeunes)\b", "SRHR.AH"),
        Rule("SRHR-HIV-01", r"\b(hiv|vih|sida|aids|sti|ist|antiretroviral)\b", "SRHR.HIV"),
        Rule("SRHR-SGBV-01", r"\b(vbg|sgbv|gbv|gender-based|gender based|violence)\b", "SRHR.SGBV"),
        Rule("SRHR-RC-01", r"\b(cervical|col de l|cancer du col|reproductive cancer|breast cancer)\b", "SRHR.RC"),
    ),
    guard=(
        r"ignore (all )?previous instructions",
        r"ignorez tout",
        r"system override",
        r"<<\s*system\s*>>",
        r"\[/?inst\]",
        r"</?s>",
        r"you must (now )?respond",
        r"do not explain your reasoning",
        r"do not reclassify",
        r"note for reviewer",
        r"confidence 1\.0",
        r"respond only in json",
        r"repondre uniquement en json",
        r"prior audit confirmed",
    ),
)

# Assumed reference rates, local units per US dollar.
DEFAULT_RATES = {"USD": 1.0, "KES": 145.0, "XOF": 605.0, "RWF": 1250.0}
DEFAULT_RATE_SOURCE = "assumed_reference_rate_FY2023_24"

# Data-quality rule, severity, stage.
RULE_CATALOGUE = (
    ("AMOUNT_MISSING", "WARN", "harmonise"),
    ("AMOUNT_NEGATIVE", "INFO", "harmonise"),
    ("AMOUNT_SEPARATOR_AMBIGUOUS", "WARN", "harmonise"),
    ("AMOUNT_UNPARSEABLE", "ERROR", "harmonise"),
    ("CONTROL_TOTAL_MISMATCH", "WARN", "reconcile"),
    ("DATE_OUT_OF_PERIOD", "ERROR", "harmonise"),
    ("DATE_UNPARSEABLE", "WARN", "harmonise"),
    ("DESCRIPTION_CASE_VARIANTS", "INFO", "harmonise"),
    ("DESCRIPTION_MISSING", "INFO", "harmonise"),
    ("FX_ASSUMED_RATES", "WARN", "load"),
    ("FX_RATE_MISSING", "WARN", "harmonise"),
    ("SOURCE_ID_COLLISION", "ERROR", "harmonise"),
    ("SRC_CONTROL_TOTAL", "INFO", "ingest"),
    ("SRC_COUNT_MISMATCH", "WARN", "ingest"),
    ("SUBTXN_SUM_MISMATCH", "ERROR", "harmonise"),
    ("UNTRUSTED_TEXT_IN_DESCRIPTION", "ERROR", "classify"),
)
SEVERITY = {rule: severity for rule, severity, _ in RULE_CATALOGUE}

MAPPING_SCHEMA = (
    "country_code string, account_code string, label string, outcome string, sha string,"
    " srhr string, confidence double, needs_review boolean, note string"
)


def fx_table(spark: SparkSession, rates: Mapping[str, float] | None = None,
             rate_source: str = DEFAULT_RATE_SOURCE) -> DataFrame:
    """Rates as a reference table; a zero or missing rate means no conversion."""
    from decimal import Decimal

    rows = [(c.upper(), Decimal(str(r)), rate_source)
            for c, r in (DEFAULT_RATES if rates is None else rates).items() if r]
    return values_table(spark, rows, "currency string, rate decimal(18,6), rate_source string")


def mapping_table(spark: SparkSession, mapping: Mapping[str, Mapping[str, Mapping]]) -> DataFrame:
    """Account mapping ``{country: {account: entry}}`` as a reference table."""
    rows = [
        (country, str(code).strip(), e.get("label"), e.get("outcome", "CLASSIFIED"), e.get("sha"), e.get("srhr"),
         float(e.get("confidence", 0.9)), bool(e.get("needs_review", False)), e.get("note"))
        for country, codes in mapping.items() for code, e in (codes or {}).items() if e
    ]
    return values_table(spark, rows, MAPPING_SCHEMA)


def catalogue_table(spark: SparkSession) -> DataFrame:
    return values_table(spark, RULE_CATALOGUE, "rule_code string, severity string, stage string")


def load_yaml(path: str) -> dict:
    """One configuration file as plain values."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading configuration files needs the yaml package") from error
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def load_sources(path: str) -> dict[str, SourceSpec]:
    return {code: SourceSpec.from_mapping(code, block) for code, block in load_yaml(path)["countries"].items()}


def load_rules(path: str) -> RuleSet:
    return RuleSet.from_mapping(load_yaml(path))


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    return mapping_table(spark, load_yaml(path)["countries"])


def load_fx(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rate table and the assumption it rests on (source, period, authoritative)."""
    block = load_yaml(path)
    about = {k: block.get(k) for k in ("rate_source", "period", "authoritative")}
    return fx_table(spark, block.get("rates") or {}, block.get("rate_source")), about
