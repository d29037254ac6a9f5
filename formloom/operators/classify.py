"""Document type by keyword counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Keywords of each type, types in the order that wins ties.
KEYWORDS = {
    "invoice": ["invoice number", "invoice no", "invoice #", "bill to", "vendor", "subtotal", "total amount", "payment terms", "amount due", "purchase order"],
    "medical_discharge": ["discharge summary", "discharge date", "admission date", "primary diagnosis", "diagnosis", "patient name", "date of birth", "treating physician", "attending physician", "medications", "follow-up", "hospital", "clinical", "discharge condition", "discharge instructions"],
    "nda": ["non-disclosure", "nondisclosure", "confidentiality agreement", "nda", "disclosing party", "receiving party", "proprietary information", "trade secret", "confidential information", "governing law", "mutual non-disclosure"],
    "lab_report": ["laboratory report", "lab report", "ordering physician", "accession", "specimen type", "reference range", "clinical interpretation", "complete blood count", "cbc", "comprehensive metabolic", "cmp", "pathology", "clia", "mrn", "reported", "collected"],
    "business_doc": ["project status", "executive summary", "key performance indicators", "kpi", "strategic recommendations", "ebitda", "compliance audit", "board report", "quarterly report", "annual report", "period ending", "prepared by", "approved by", "document classification"],
}


def document_type(text: Column) -> Column:
    """The type of most distinct keywords, the first among equals; invoice without any."""

    def count(low: Column, words: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])

    def choose(scores: Column) -> Column:
        best = F.array_max(scores)
        names = F.array(*[F.lit(kind) for kind in KEYWORDS])
        return F.when(best > 0, F.element_at(names, F.array_position(scores, best).cast("int"))).otherwise("invoice")

    lowered = F.lower(F.coalesce(text, F.lit("")))
    return let(lowered, lambda low: let(F.array(*[count(low, words) for words in KEYWORDS.values()]), choose))


def with_document_type(docs: DataFrame, text_col: str = "text", out: str = "document_type") -> DataFrame:
    return docs.withColumn(out, document_type(docs[text_col]))


#: Phrases of traces that tell the mode.
USED_MODEL = ("used the llm reasoning layer",)
USED_TEMPLATE = ("applied learned template anchors", "used learned template anchors", "matched learned template")
USED_RULES = ("fell back to rule-based", "rule-based label and regex")


def effective_mode(requested: Column, trace: Column) -> Column:
    """The mode a trace shows, a model before a template before rules; the requested one if it shows none."""
    has = lambda low, phrases: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])
    low = F.lower(F.array_join(F.coalesce(trace, F.array().cast("array<string>")), " "))
    return (
        F.when(has(low, USED_MODEL), "llm-assisted").when(has(low, USED_TEMPLATE), "template").when(has(low, USED_RULES), "rule-based").otherwise(requested)
    )
