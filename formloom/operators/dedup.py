"""Exact duplicates: by content hash inside a batch and against what is stored, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, let, py_float, strip


def first_of_each_hash(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Adds content_hash and is_duplicate: every row but the first id of its hash.

    The first id is a grouped minimum, combined before the shuffle, so a hash that a third
    of all rows share is no hot task; a window over the hash would be one.  First ids are
    marked by an equi-join on hash and id, which spreads the copies of a text.
    """
    hashed = docs.withColumn("content_hash", content_hash(docs[text_col]))
    firsts = hashed.groupBy(F.col("content_hash").alias("__hash")).agg(F.min(id_col).alias("__first"))
    marked = hashed.join(firsts, (F.col("content_hash") == F.col("__hash")) & (F.col(id_col) == F.col("__first")), "left")
    return marked.withColumn("is_duplicate", F.col("__first").isNull()).drop("__hash", "__first")


def first_completed(rows: DataFrame, order: str, hash_col: str = "content_hash", status: str = "status", name: str = "source_file") -> DataFrame:
    """Rows of a batch with ``status`` duplicate, and ``errors`` saying of which, for all but the first completed of a content hash.

    Failed and duplicate rows, and rows without a hash, neither count nor change.
    """
    counts = ~F.col(status).isin("failed", "duplicate") & (F.coalesce(F.col(hash_col), F.lit("")) != "")
    firsts = rows.filter(counts).groupBy(F.col(hash_col).alias("__hash")).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("__first")
    )
    joined = rows.join(firsts, counts & (F.col(hash_col) == F.col("__hash")), "left")
    later = F.coalesce(F.col("__first.o") != F.col(order), F.lit(False))
    told = F.concat(F.lit("Duplicate: same content as '"), F.col("__first.n"), F.lit("' in this batch"))
    return joined.withColumns({"errors": F.when(later, told).otherwise(F.col("errors")), status: F.when(later, "duplicate").otherwise(F.col(status))}).drop("__hash", "__first")


def first_upload(files: DataFrame, order: str, content: str = "content", name: str = "name") -> DataFrame:
    """Adds ``hash`` and ``skip_reason`` (null for the first upload of the same bytes)."""
    hashed = files.withColumn("hash", F.sha2(content, 256))
    firsts = hashed.groupBy(F.col("hash").alias("__hash")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("__first"))
    joined = hashed.join(firsts, F.col("hash") == F.col("__hash"))
    told = F.concat(F.lit("duplicate of '"), F.col("__first.n"), F.lit("' in this batch"))
    return joined.withColumn("skip_reason", F.when(F.col("__first.o") != F.col(order), told)).drop("__hash", "__first")


#: What a duplicate's row says, by what it matched.
DUPLICATE = {
    "content_hash": ("Duplicate: identical document content was already processed.", "Content hash matched an existing record — skipping re-processing."),
    "semantic_fingerprint": (
        "Duplicate: same document was already processed in a different format (e.g. scanned vs. text-based PDF).",
        "Semantic fingerprint matched an existing record — this document's key fields match one already processed.",
    ),
}


def duplicate_rows(docs: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The result rows of documents whose key the store holds: no data but type and file, no checks, no review."""
    error, step = DUPLICATE[key]
    seen = docs.join(store.filter(F.col(key) != "").select(key).distinct(), key, "left_semi")
    kind = F.lit("unknown") if key == "content_hash" else F.col("document_type")
    return seen.select(
        "source_file", kind.alias("document_type"), "content_hash", F.lit(True).alias("duplicate"), F.lit(False).alias("needs_review"),
        F.array(F.lit(error)).alias("errors"), F.array(F.lit(step)).alias("trace"),
    )


def not_seen(docs: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store does not hold; an empty key never matches."""
    return docs.join(store.filter(F.col(key) != "").select(key).distinct(), key, "left_anti")


#: Fields that identify a document of each type.
IDENTIFYING = {
    "invoice": ("vendor_name", "invoice_number", "invoice_date", "total_amount"),
    "business_doc": ("company_name", "report_id", "report_date"),
    "medical_discharge": ("patient_name", "facility_name", "admission_date"),
    "nda": ("disclosing_party", "receiving_party", "agreement_date"),
    "lab_report": ("patient_id", "lab_name", "collected_date"),
}


def fingerprint(*fields: Column, numbers: tuple[int, ...] = ()) -> Column:
    """SHA-256 of the key fields, lower-cased and stripped; empty with fewer than two of them.

    ``numbers`` tells which of the fields are numbers: they are written as Python does, and 0 is empty.
    """
    text = lambda f: F.coalesce(F.lower(strip(f)), F.lit(""))
    parts = [F.coalesce(F.when(f != 0, py_float(f)), F.lit("")) if i in numbers else text(f) for i, f in enumerate(fields)]
    return let(
        F.array(*parts),
        lambda p: F.when(F.size(F.filter(p, lambda x: x != "")) >= 2, F.sha2(F.array_join(p, "|"), 256)).otherwise(""),
    )


def document_fingerprint(rows: DataFrame, document_type: str) -> Column:
    """The fingerprint of a type's identifying fields; fields that the rows lack are empty, a type without any has none."""
    names = IDENTIFYING.get(document_type, ())
    if not names:
        return F.lit("")
    columns = [F.col(f) if f in rows.columns else F.lit(None).cast("string") for f in names]
    numbers = tuple(i for i, f in enumerate(names) if f in rows.columns and isinstance(rows.schema[f].dataType, T.NumericType))
    return fingerprint(*columns, numbers=numbers)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in place of those with their key; columns of either side are kept."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
