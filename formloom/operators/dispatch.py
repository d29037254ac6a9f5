"""Extraction by document type and by mode, with the trace that tells what was done."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money
from . import catalog, extract, provenance, reports
from .classify import KEYWORDS, with_document_type
from .extract import MONEY_FIELDS
from .templates import anchor_values, best_template

#: Least similarity at which a template is used, by mode.
THRESHOLD = {"template-only": 0.55, "adaptive-local": 0.55, "llm-assisted": 0.68}
MODES = ("template-only", "rule-based", "adaptive-local", "llm-assisted")


def record_of(docs: DataFrame, document_type: str, text_col: str = "text") -> DataFrame:
    """All rule-extracted fields of a type, lists too; documents must be of that type."""
    text = F.col(text_col)
    if document_type == "medical_discharge":
        rows = extract.extract_fields(docs, document_type, text_col)
        return rows.withColumns({"medications": extract.medications(text), "discharge_instructions": extract.discharge_instructions(text)})
    if document_type == "nda":
        return extract.extract_fields(docs, document_type, text_col).withColumn("agreement_type", extract.agreement_type(text))
    if document_type == "lab_report":
        rows = extract.extract_fields(docs, document_type, text_col)
        panels = reports.lab_panels(text)
        none = F.filter(panels, lambda p: F.lit(False))
        return rows.withColumns({
            "lab_name": extract.lab_name(text), "clinical_interpretation": reports.clinical_interpretation(text), "lab_panels": panels, "abnormal_results": none,
        })
    if document_type == "business_doc":
        rows = extract.extract_fields(docs, document_type, text_col)
        return rows.withColumns({
            "company_name": extract.company_name(text), "document_subtype": reports.document_subtype(text), "executive_summary": reports.executive_summary(text),
            "kpis": reports.kpis(text), "recommendations": reports.recommendations(text),
        })
    return extract.extract_invoices(docs, text_col)


def records(docs: DataFrame, text_col: str = "text") -> dict[str, DataFrame]:
    """Documents by detected type, each with the fields of its type."""
    typed = docs if "document_type" in docs.columns else with_document_type(docs, text_col)
    return {kind: record_of(typed.filter(F.col("document_type") == kind), kind, text_col) for kind in KEYWORDS}


def long_fields(rows: DataFrame, document_type: str, id_col: str, known: dict[str, Column] | None = None) -> DataFrame:
    """(id, document_type, field, value) of the fields of a type's empty record; lists and structs as JSON, empty lists as null."""
    out = []
    for f in catalog.EMPTY.get(document_type, catalog.EMPTY["invoice"]):
        if known and f in known:
            value = known[f]
        elif f not in rows.columns:
            value = F.lit(None).cast("string")
        elif rows.schema[f].dataType.typeName() in ("array", "struct", "map"):
            value = F.when(F.size(f) > 0, F.to_json(f, {"ignoreNullFields": "false"}))
        else:
            value = F.col(f).cast("string")
        out.append(F.struct(F.lit(f).alias("field"), value.alias("value")))
    return rows.select(id_col, F.lit(document_type).alias("document_type"), F.inline(F.array(*out)))


def extract_all(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Long fields of all documents, each by the rules of its detected type."""
    parts = [long_fields(rows, kind, id_col) for kind, rows in records(docs, text_col).items()]
    return reduce(DataFrame.unionByName, parts)


def _steps(*steps: Column | None) -> Column:
    return F.filter(F.array(*[s.cast("string") for s in steps if s is not None]), lambda x: x.isNotNull())


def _listed(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(F.array_sort(names), ", ")).otherwise("none")


def extract_invoice_documents(docs: DataFrame, store: DataFrame | None, mode: str, id_col: str, text_col: str = "text", client: Callable[[str], str] | None = None) -> DataFrame:
    """Invoice fields and ``trace`` of documents of type invoice in a mode.

    ``docs`` have ``vector`` (the page signature, empty for texts); ``store`` has
    (document_type, ord, template_name, vector, anchors).  Rules come first, anchors of a
    template that is similar enough fill what they leave empty, then inference.  In
    template-only mode anchors alone count, and a document without such a template gets
    ``failed``.  In llm-assisted mode ``asks`` tells which documents a model is to be asked
    for: those without a similar template, or whose required fields are still empty.
    """
    if mode not in MODES:
        mode = "adaptive-local"
    text = F.col(text_col)
    rows = docs.withColumn("document_type", F.lit("invoice"))
    if mode == "rule-based" or store is None:
        matched = rows.withColumns({"score": F.lit(None).cast("double"), "template_name": F.lit(None).cast("string"), "anchors": F.lit(None).cast("map<string,string>")})
    else:
        named = store.select("document_type", "ord", F.col("template_name"), "anchors")
        best = best_template(rows.select(id_col, "document_type", "vector", F.col(text_col).alias("text")), store, id_col)
        best = best.join(named, ["document_type", "ord"]).select(F.col(id_col).alias("__id"), "score", "template_name", "anchors")
        matched = rows.join(best, F.col(id_col) == F.col("__id"), "left").drop("__id")
    limit = THRESHOLD.get(mode, 2.0)
    hit = F.coalesce(F.col("score") >= limit, F.lit(False))
    matched = matched.withColumns({"hit": hit, "__found": F.when(hit, anchor_values(F.col("anchors"), text))})
    fields = [f for f in catalog.EMPTY["invoice"] if f not in ("line_items", "currency")] + ["currency"]
    if mode == "template-only":
        values = {f: F.element_at("__found", f) for f in fields}
        values |= {f: money(values[f]) for f in MONEY_FIELDS}
        values["currency"] = F.coalesce(F.element_at("__found", "currency"), F.lit("USD"))
        trace = _steps(
            F.lit("Started template-only extraction."),
            F.concat(F.lit("Matched learned template `"), F.col("template_name"), F.lit("` with score "), F.col("score").cast("string"), F.lit(".")),
        )
        out = matched.withColumns(values | {"line_items": extract.line_items(text), "failed": ~F.col("hit"), "trace": trace})
        return out.drop("__found", "anchors", "score", "hit")
    ruled = extract.extract_invoices(matched, text_col)
    template = {f: money(F.element_at("__found", f)) if f in MONEY_FIELDS else F.element_at("__found", f) for f in fields}
    filled = provenance.gaps({f: F.col(f) for f in fields}, template)
    ruled = ruled.withColumn("__filled", F.coalesce(filled, F.array().cast("array<string>")))
    ruled = ruled.withColumns({f: F.coalesce(F.col(f) if f in MONEY_FIELDS else F.when(F.col(f) != "", F.col(f)), template[f]) for f in fields})
    present = F.filter(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", f) for f in fields]), lambda x: x.isNotNull())
    ruled = ruled.withColumn("__present", F.concat(present, F.when(F.size("line_items") > 0, F.array(F.lit("line_items"))).otherwise(F.array().cast("array<string>"))))
    before = {f: F.col(f).isNull() for f in ("currency", "total_amount", "invoice_number", "invoice_date")}
    ruled = ruled.withColumns({f"__no_{f}": c for f, c in before.items()}).withColumn("asks", catalog.needs_model(ruled, "invoice"))
    inferred = extract.infer_invoice_fields(ruled, text_col)
    named = F.filter(F.array(*[F.when(F.col(f"__no_{f}") & F.col(f).isNotNull(), f) for f in before]), lambda x: x.isNotNull())
    candidate = F.concat(F.lit("Best learned template candidate was `"), F.col("template_name"), F.lit("` with similarity "), F.col("score").cast("string"), F.lit("."))
    applied = F.concat(F.lit("Applied learned template anchors to extract fields. Fields with values: "), _listed(F.col("__present")), F.lit("."))
    fell_back = F.concat(F.lit("Fell back to rule-based label and regex extraction. Fields with values: "), _listed(F.col("__present")), F.lit("."))
    if mode == "rule-based":
        trace = F.array(F.lit("Ran rule-based label and regex extraction."))
    else:
        trace = _steps(
            F.lit("Generated document signature from top lines and keywords."),
            F.coalesce(candidate, F.lit("No learned template candidates were available yet.")),
            provenance.gap_step(F.col("__filled"), "Template text anchors"),
            F.when(F.col("hit"), applied).otherwise(fell_back),
            F.lit("Detected document type: invoice."),
            provenance.inference_step(named),
        )
    out = inferred.withColumn("trace", trace)
    drop = ["__found", "__filled", "__present", "anchors", "score", *[f"__no_{f}" for f in before]]
    if mode == "llm-assisted":
        out = out.withColumn("asks", F.col("asks") | ~F.col("hit"))
    else:
        drop.append("asks")
    return out.drop(*drop, "hit")
