"""Checks of a record as an array of (field, status, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_empty, is_empty_list, valid_date

#: Required fields of the checks of each type.
REQUIRED = {
    "invoice": ("vendor_name", "invoice_number", "invoice_date", "total_amount"),
    "medical_discharge": ("patient_name", "admission_date", "discharge_date", "primary_diagnosis"),
    "nda": ("disclosing_party", "receiving_party", "agreement_date"),
    "lab_report": ("patient_name",),
    "business_doc": ("company_name",),
}


def _check(field: str, status: Column | str, message: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(field).alias("field"), as_column(status).alias("status"), as_column(message).alias("message"))


def _either(field: str, good: Column, bad: str, yes: Column | str, no: str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _check(field, F.when(good, "pass").otherwise(bad), F.when(good, as_column(yes)).otherwise(F.lit(no)))


def _required(kind: str) -> list[Column]:
    out = []
    for f in REQUIRED[kind]:
        missing = is_empty(F.col(f).cast("string"))
        out.append(_either(f, ~missing, "fail", "Required field is present.", "Required field is missing."))
    return out


def _date(field: str, missing: str | None, bad: str, note: str) -> Column:
    v = F.col(field)
    none = F.lit(None).cast("struct<field:string,status:string,message:string>")
    absent = none if missing is None else _check(field, missing, "No date provided.")
    return F.when(is_empty(v), absent).otherwise(_either(field, valid_date(v), bad, "Date format is valid.", note))


def _counted(field: str, what: str, none: str) -> Column:
    v = F.col(field)
    return _either(field, ~is_empty_list(v), "warn", F.concat(F.size(v).cast("string"), F.lit(f" {what}")), none)


def _invoice() -> list[Column]:
    total, subtotal, tax, shipping = (F.col(c) for c in ("total_amount", "subtotal", "tax", "shipping_handling"))
    expected = F.round(subtotal + tax + F.coalesce(shipping, F.lit(0.0)), 2)
    label = F.when(F.coalesce(shipping, F.lit(0.0)) != 0, "Subtotal + tax + shipping").otherwise("Subtotal + tax")
    note = "Date should be in YYYY-MM-DD or MM/DD/YYYY."
    agrees = expected == F.round(total, 2)
    consistency = F.struct(
        F.lit("total_consistency").alias("field"),
        F.when(agrees, "pass").otherwise("fail").alias("status"),
        F.when(agrees, F.concat(label, F.lit(" matches total.")))
        .otherwise(F.format_string("Expected total %.2f, but found %.2f.", expected, F.round(total, 2)))
        .alias("message"),
    )
    return [
        *_required("invoice"),
        _date("invoice_date", "warn", "fail", note),
        _date("due_date", "warn", "fail", note),
        _either("total_amount", F.coalesce(total > 0, F.lit(False)), "fail", "Total amount is positive.", "Total amount must be > 0."),
        _either("subtotal", subtotal.isNotNull(), "warn", "Subtotal is present.", "Subtotal not found."),
        _either("tax", tax.isNotNull(), "warn", "Tax amount is present.", "Tax amount not found."),
        F.when(shipping.isNotNull(), _check("shipping_handling", "pass", "Shipping/handling is present.")),
        _either("currency", ~is_empty(F.trim("currency")), "warn", F.concat(F.lit("Currency: "), F.col("currency"), F.lit(".")), "Currency not identified."),
        _counted("line_items", "line item(s) found.", "No line items extracted."),
        F.when(total.isNotNull() & subtotal.isNotNull() & tax.isNotNull(), consistency),
    ]


def _medical() -> list[Column]:
    note = "Date should be YYYY-MM-DD or MM/DD/YYYY."
    iso = r"^\d{4}-\d{1,2}-\d{1,2}$"
    a, d = (F.when(F.col(c).rlike(iso), F.try_to_date(F.col(c), "yyyy-M-d")) for c in ("admission_date", "discharge_date"))
    order = _either("date_order", d >= a, "fail", "Discharge date is on or after admission date.", "Discharge date is before admission date.")
    return [
        *_required("medical_discharge"),
        _date("admission_date", "warn", "fail", note), _date("discharge_date", "warn", "fail", note),
        _date("follow_up_date", None, "fail", note), _date("date_of_birth", None, "fail", note),
        F.when(a.isNotNull() & d.isNotNull(), order),
        _counted("medications", "medication(s) recorded.", "No medications recorded."),
    ]


def _nda() -> list[Column]:
    note = "Date should be YYYY-MM-DD or MM/DD/YYYY."
    known = F.coalesce(F.col("agreement_type").isin("mutual", "one-way"), F.lit(False))
    return [
        *_required("nda"),
        *[_date(c, "warn", "fail", note) for c in ("agreement_date", "effective_date", "expiration_date")],
        _either("agreement_type", known, "warn", F.concat(F.lit("Agreement type is "), F.col("agreement_type"), F.lit(".")), "Agreement type (mutual/one-way) not detected."),
        _either("governing_law", ~is_empty(F.col("governing_law")), "warn", "Governing law is present.", "Governing law not found."),
    ]


def _lab() -> list[Column]:
    note = "Date could not be parsed as YYYY-MM-DD or MM/DD/YYYY."
    abnormal = F.col("abnormal_results")
    flagged = F.concat(F.size(abnormal).cast("string"), F.lit(" abnormal result(s) flagged — review recommended."))
    return [
        *_required("lab_report"),
        *[_date(c, "warn", "warn", note) for c in ("collected_date", "reported_date")],
        _counted("lab_panels", "lab result(s) recorded.", "No lab panel results found."),
        _check("abnormal_results", F.when(is_empty_list(abnormal), "pass").otherwise("warn"), F.when(is_empty_list(abnormal), "No abnormal flags detected.").otherwise(flagged)),
    ]


def _business() -> list[Column]:
    return [
        *_required("business_doc"),
        *[_either(c, ~is_empty(F.col(c)), "warn", "Field is present.", "Field not found.") for c in ("document_subtype", "report_period", "prepared_by")],
        _counted("kpis", "KPI(s) recorded.", "No KPIs found."),
    ]


_CHECKS = {"invoice": _invoice, "medical_discharge": _medical, "nda": _nda, "lab_report": _lab, "business_doc": _business}


def with_checks(rows: DataFrame, document_type: str, out: str = "checks") -> DataFrame:
    checks = _CHECKS.get(document_type, _invoice)()
    return rows.withColumn(out, F.filter(F.array(*checks), lambda c: c.isNotNull()))


def status_count(checks: Column, status: str) -> Column:
    return F.size(F.filter(checks, lambda c: c["status"] == status))


def needs_review(errors: Column, checks: Column, mode: Column, template_hit: Column) -> Column:
    local = mode.isin("adaptive-local", "template-only") & ~template_hit
    return (F.size(errors) > 0) | (status_count(checks, "fail") > 0) | local
