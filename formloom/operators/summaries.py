"""Completeness and summary rows of processed batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_filled(v: Column) -> Column:
    return v.isNotNull() & (v != "") & (v != "null")


def _count(tests) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests], F.lit(0))


def completeness(fields: dict[str, Column], optional: set[str], lists: dict[str, Column] | None = None) -> Column:
    """Struct of filled, total, share and band; optional fields count only where present, lists once more."""
    lists = lists or {}
    filled = _count([is_filled(v) for v in fields.values()] + [F.size(v) > 0 for v in lists.values()])
    total = F.lit(len([f for f in fields if f not in optional]) + len(lists)) + _count([is_filled(v) for f, v in fields.items() if f in optional])
    share = F.when(total > 0, filled / total).otherwise(0.0)
    band = F.when(share >= 0.8, "Good").when(share >= 0.5, "Partial").otherwise("Low")
    return F.struct(filled.alias("filled"), total.alias("total"), share.alias("share"), band.alias("band"))


def completeness_text(c: Column) -> Column:
    """``filled/total (percent%)``, the percentage rounded down."""
    percent = F.when(c["total"] > 0, F.floor(c["filled"] * 100 / c["total"])).otherwise(0)
    return F.concat(c["filled"].cast("string"), F.lit("/"), c["total"].cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)"))


def template_hit(trace: Column) -> Column:
    """Struct of a matched template's name and score (two digits, halves up) from an array of steps; dashes without one."""
    matched = r"Matched learned template `([^`]+)` with score ([0-9]+(?:\.[0-9]+)?)"
    best = r"Best learned template candidate was `([^`]+)` with similarity ([0-9]+(?:\.[0-9]+)?)"
    step = lambda p: F.get(F.filter(trace, lambda s: s.rlike(p)), F.lit(0))
    hit = lambda p: F.struct(
        F.regexp_extract(step(p), p, 1).alias("name"), F.format_string("%.2f", F.regexp_extract(step(p), p, 2).try_cast("double")).alias("score")
    )
    applied = F.exists(trace, lambda s: F.lower(s).rlike("(applied|used) learned template anchors"))
    none = F.struct(F.lit("—").alias("name"), F.lit("—").alias("score"))
    return F.when(step(matched).isNotNull(), hit(matched)).when(applied & step(best).isNotNull(), hit(best)).otherwise(none)


def batch_status(failed: Column, duplicate: Column, review: Column) -> Column:
    return F.when(failed, "failed").when(duplicate, "duplicate").when(review, "needs_review").otherwise("success")


def batch_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, approved, review, and skipped or failed."""
    n = lambda *s: F.count_if(F.col(status).isin(*s))
    return rows.agg(F.count("*").alias("total"), n("success").alias("approved"), n("needs_review").alias("review"), n("duplicate", "failed").alias("skipped_failed"))
