"""Batches of processed documents: routing, summary rows, rates and reviewed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_FLOAT, one_decimal, strip
from .extract import MONEY_FIELDS
from .provenance import model_used
from .summaries import template_hit
from .validate import status_count

PREVIEW_CHARS, STATUS_LINES, CANDIDATE_LINES = 20_000, 8, 8


def route(rows: DataFrame, approved: Column) -> tuple[DataFrame, DataFrame]:
    """(approved, flagged) rows of a batch; duplicates and failures are in neither."""
    live = rows.filter(~F.col("status").isin("duplicate", "failed"))
    return live.filter(approved), live.filter(~F.coalesce(approved, F.lit(False)))


def summary_rows(rows: DataFrame, completeness: Column) -> DataFrame:
    """The summary table of a batch.

    ``rows`` have source_file, status_label, extraction_mode, trace, checks, errors, content_hash
    and seconds; ``completeness`` is the text of ``summaries.completeness_text``.  Duplicates
    and failures have only their file, status, errors and hash.
    """
    processed = ~F.col("status_label").isin("duplicate", "failed")
    only = lambda c: F.when(processed, c)
    hit = template_hit(F.col("trace"))
    return rows.select(
        "source_file", "status_label",
        only(F.coalesce("extraction_mode", F.lit("—"))).alias("extraction_mode"),
        only(hit["name"]).alias("template"), only(hit["score"]).alias("score"),
        only(F.when(model_used(F.col("trace")), "Yes").otherwise("No")).alias("model_used"),
        only(F.coalesce(F.col("seconds").cast("string"), F.lit("—"))).alias("seconds"),
        only(completeness).alias("completeness"),
        *[only(status_count(F.col("checks"), s)).alias(f"n_{s}") for s in ("pass", "warn", "fail")],
        F.array_join("errors", "; ").alias("errors"), "content_hash",
    )


def review_rate(counts: DataFrame, documents: str = "documents", corrections: str = "corrections") -> Column:
    """Corrections as a percentage of documents, a dash without documents."""
    return F.when(F.col(documents) > 0, F.concat(one_decimal(F.col(corrections) * 100.0 / F.col(documents)), F.lit("%"))).otherwise("—")


def form_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Reviewed form texts as record values: stripped, blank ones null, money as numbers beside the text that is none.

    A missing type is invoice, a missing currency of an invoice is USD.
    """
    text = {f: strip(F.col(f)) for f in fields}
    filled = {f: F.when(t != "", t) for f, t in text.items()}
    out = {}
    for f in fields:
        if f in MONEY_FIELDS:
            bare = strip(F.regexp_replace(text[f], "[,$]", ""))
            out[f] = F.when(bare.rlike(PY_FLOAT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
            out[f"{f}_raw"] = filled[f]
        else:
            out[f] = filled[f]
    kind = F.coalesce(out.get("document_type", F.lit(None).cast("string")), F.lit("invoice"))
    currency = out.get("currency", F.lit(None).cast("string"))
    out["document_type"] = kind
    out["currency"] = F.when(kind == "invoice", F.coalesce(currency, F.lit("USD"))).otherwise(currency)
    return rows.withColumns(out)


def line_items_of(text: Column, schema: T.DataType | str) -> Column:
    """Line items of a form's JSON text; none where it is no JSON list."""
    empty = F.from_json(F.lit("[]"), schema)
    is_list = strip(text).startswith("[")
    return F.coalesce(F.when(is_list, F.from_json(text, schema, {"mode": "PERMISSIVE"})), empty)


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def last_lines(lines: Column, n: int = STATUS_LINES) -> Column:
    return F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines)
