"""The catalogue of fields: which a type has, which are required, and the tables made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_empty, is_empty_list

#: Catalogued fields of each type, in order.
FIELDS = {
    "invoice": "vendor_name invoice_number invoice_date due_date bill_to po_number payment_terms subtotal tax shipping_handling total_amount currency line_items".split(),
    "medical_discharge": (
        "patient_name date_of_birth mrn gender facility_name admission_date discharge_date length_of_stay_days attending_physician specialty insurance primary_diagnosis"
        " primary_diagnosis_icd10 secondary_diagnoses hospital_course discharge_condition discharge_instructions follow_up_date follow_up_provider medications vitals_at_discharge"
    ).split(),
    "nda": (
        "disclosing_party receiving_party agreement_date effective_date expiration_date agreement_type confidentiality_period governing_law permitted_use"
        " signatory_disclosing signatory_receiving"
    ).split(),
    "lab_report": (
        "patient_name date_of_birth mrn gender lab_name clia_number ordering_physician ordering_specialty accession_number specimen_type collected_date reported_date"
        " report_id reviewing_pathologist clinical_interpretation lab_panels abnormal_results"
    ).split(),
    "business_doc": (
        "company_name document_subtype report_period report_date report_id prepared_by approved_by classification executive_summary kpis recommendations"
    ).split(),
}
#: Fields that a record of a type must have.
REQUIRED = {
    "invoice": {"vendor_name", "invoice_number", "invoice_date", "total_amount", "line_items"},
    "medical_discharge": {"patient_name", "admission_date", "discharge_date", "primary_diagnosis"},
    "nda": {"disclosing_party", "receiving_party", "agreement_date"},
    "lab_report": {"patient_name"},
    "business_doc": {"company_name"},
}
#: Fields that are not selected unless asked for.
NOT_SELECTED = {
    "medical_discharge": {"specialty", "insurance", "hospital_course", "discharge_instructions", "follow_up_provider", "vitals_at_discharge"},
    "nda": {"signatory_disclosing", "signatory_receiving"},
    "lab_report": {"clia_number", "ordering_specialty"},
    "business_doc": {"recommendations"},
}
#: Fields that hold lists or structs, stored as JSON.
JSON_FIELDS = {"line_items", "secondary_diagnoses", "medications", "vitals_at_discharge", "lab_panels", "abnormal_results", "kpis", "recommendations"}
#: Column types other than TEXT.
NUMBERS = {"subtotal": "REAL", "tax": "REAL", "shipping_handling": "REAL", "total_amount": "REAL", "length_of_stay_days": "INTEGER"}
#: Table of each type.
TABLES = {"invoice": "invoices", "medical_discharge": "discharge_summaries", "nda": "ndas", "lab_report": "lab_reports", "business_doc": "business_docs"}
#: Columns that every such table has.
SYSTEM_COLUMNS = {
    "id": "INTEGER PRIMARY KEY AUTOINCREMENT",
    "source_file": "TEXT NOT NULL",
    "original_filename": "TEXT",
    "content_hash": "TEXT",
    "processed_at": "TEXT DEFAULT (datetime('now'))",
}
#: Fields of an empty record of each type; lists start empty, an invoice's currency is USD.
EMPTY = {
    "invoice": FIELDS["invoice"],
    "medical_discharge": (
        "facility_name patient_name date_of_birth admission_date discharge_date primary_diagnosis secondary_diagnoses treating_physician"
        " discharge_condition discharge_instructions follow_up_date medications"
    ).split(),
    "nda": "agreement_date effective_date expiration_date disclosing_party receiving_party agreement_type confidentiality_period governing_law permitted_use".split(),
    "lab_report": FIELDS["lab_report"],
    "business_doc": FIELDS["business_doc"],
}
_SPARK = {"REAL": T.DoubleType(), "INTEGER": T.IntegerType()}
Selection = dict[str, list[str]]


def default_selection() -> Selection:
    return {kind: [f for f in fields if f not in NOT_SELECTED.get(kind, ())] for kind, fields in FIELDS.items()}


def select_fields(selection: Selection, document_type: str, fields: list[str]) -> Selection:
    """A selection in which a type has the fields asked for and all required ones, in the catalogue's order, unknown ones last."""
    catalogue = FIELDS.get(document_type, [])
    wanted = set(fields) | REQUIRED.get(document_type, set())
    place = {f: i for i, f in enumerate(catalogue)}
    return selection | {document_type: sorted(sorted(wanted), key=lambda f: place.get(f, len(catalogue)))}


def selected(selection: Selection, document_type: str) -> list[str]:
    return selection.get(document_type, default_selection().get(document_type, []))


def display_fields(selection: Selection, document_type: str) -> tuple[list[str], list[str], set[str]]:
    """(order, list fields, optional fields) of a type's selection."""
    keys = selected(selection, document_type)
    known = set(FIELDS.get(document_type, []))
    return ["document_type", *keys], [k for k in keys if k in JSON_FIELDS & known], {k for k in keys if k not in REQUIRED.get(document_type, set())}


def ddl(selection: Selection, document_type: str) -> str:
    """CREATE TABLE of a type: system columns, then its selected fields in the catalogue's order."""
    chosen = set(selected(selection, document_type))
    lines = [f"    {name} {kind}" for name, kind in SYSTEM_COLUMNS.items()]
    for f in FIELDS.get(document_type, []):
        if f in chosen:
            lines.append(f"    {f} {NUMBERS.get(f, 'TEXT')}" + (" NOT NULL" if f in REQUIRED[document_type] else ""))
    return f"CREATE TABLE IF NOT EXISTS {TABLES.get(document_type, document_type)} (\n" + ",\n".join(lines) + "\n);"


def table_schema(document_type: str, selection: Selection | None = None) -> T.StructType:
    """Columns of a type's table: all of its fields from the start, so no later one is a migration."""
    fields = FIELDS[document_type] if selection is None else selected(selection, document_type)
    system = [T.StructField(c, T.StringType()) for c in SYSTEM_COLUMNS if c != "id"]
    return T.StructType([*system, *[T.StructField(f, _SPARK.get(NUMBERS.get(f, ""), T.StringType())) for f in fields]])


def results_schema() -> T.StructType:
    """Columns of the table of all results: keys of the document, then every field of any type, numbers of invoices as such."""
    head = ["source_file", "original_filename", "content_hash", "semantic_fingerprint", "document_type"]
    fields = dict.fromkeys(f for kind in FIELDS for f in [*FIELDS[kind], *EMPTY[kind]])
    return T.StructType([T.StructField(c, _SPARK.get(NUMBERS.get(c, ""), T.StringType())) for c in [*head, *fields]])


def type_table(results: DataFrame, document_type: str, selection: Selection | None = None, now: Column | None = None) -> DataFrame:
    """The table of a type: its records' system columns and selected fields; lists and structs as JSON, fields they lack null.

    ``now`` is when they were processed, UTC to the second if not given.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows = results.filter(F.col("document_type") == document_type)
    stamp = now if now is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    out = []
    for field in table_schema(document_type, selection or default_selection()):
        c = field.name
        if c == "processed_at":
            out.append(stamp.cast("string").alias(c))
        elif c == "original_filename":
            given = F.col(c) if c in results.columns else F.lit(None)
            out.append(F.coalesce(F.when(given != "", given), F.col("source_file")).alias(c))
        elif c not in results.columns:
            out.append(F.lit(None).cast(field.dataType).alias(c))
        elif isinstance(results.schema[c].dataType, nested):
            out.append(F.to_json(c, {"ignoreNullFields": "false"}).alias(c))
        else:
            out.append(F.col(c).cast(field.dataType).alias(c))
    return rows.select(*out)


def empty_record(document_type: str) -> dict[str, Column]:
    """Column of each field of an empty record of a type, of invoices for an unknown one."""
    kind = document_type if document_type in EMPTY else "invoice"
    out = {"document_type": F.lit(kind)}
    for f in EMPTY[kind]:
        out[f] = F.array().cast("array<string>") if f in JSON_FIELDS else F.lit("USD") if f == "currency" else F.lit(None).cast(_SPARK.get(NUMBERS.get(f, ""), T.StringType()))
    return out


def _required_of(document_type: str) -> set[str]:
    return REQUIRED.get(document_type) or {"vendor_name", "total_amount"}


def needs_model(rows: DataFrame, document_type: str) -> Column:
    """Whether any required field of a type is missing or empty."""
    nested = T.ArrayType
    tests = []
    for f in sorted(_required_of(document_type)):
        if f not in rows.columns:
            tests.append(F.lit(True))
        else:
            tests.append(is_empty_list(F.col(f)) if isinstance(rows.schema[f].dataType, nested) else is_empty(F.col(f).cast("string")))
    return reduce(lambda a, b: a | b, tests)


def required_pass(checks: Column, document_type: Column) -> Column:
    """Whether each required field of a type has a check that passed; checks are ``array<struct<field, status, message>>``."""
    passed = F.transform(F.filter(checks, lambda c: c["status"] == "pass"), lambda c: c["field"])
    wanted = F.array(*[F.lit(f) for f in sorted(_required_of(""))])
    for kind in REQUIRED:
        wanted = F.when(document_type == kind, F.array(*[F.lit(f) for f in sorted(REQUIRED[kind])])).otherwise(wanted)
    return F.size(F.array_except(wanted, passed)) == 0
