"""Confidence, badges, approval, equivalence and other scores of extracted fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PY_FLOAT, to_number

#: Confidence by source for the worst check pass, warn, fail.
CONFIDENCE = {
    "Cross-validated": (0.97, 0.728, 0.339),
    "Manual": (0.95, 0.712, 0.332),
    "LLM": (0.88, 0.66, 0.308),
    "Template": (0.82, 0.615, 0.287),
    "Spatial": (0.78, 0.585, 0.273),
    "Document": (0.75, 0.562, 0.262),
    "Rule-based": (0.72, 0.54, 0.252),
    "Inferred": (0.65, 0.488, 0.227),
}


#: The row that a document's baseline stands for.
_BASELINES = {0.88: "LLM", 0.82: "Template", 0.78: "Spatial", 0.72: "Rule-based"}


def field_confidence(source: Column, worst: Column, empty: Column, baseline: Column | None = None) -> Column:
    """Confidence by a field's source and the worst of its checks; ``baseline`` (0.75 if not given) serves where the source is null or unknown."""
    of = lambda name: F.when(worst == "fail", CONFIDENCE[name][2]).when(worst == "warn", CONFIDENCE[name][1]).otherwise(CONFIDENCE[name][0])
    out = of("Document")
    if baseline is not None:
        for value, name in _BASELINES.items():
            out = F.when(baseline == value, of(name)).otherwise(out)
    for name in CONFIDENCE:
        if name != "Document":
            out = F.when(source == name, of(name)).otherwise(out)
    return F.when(empty, 0.0).otherwise(out)


def worst_status(statuses: Column) -> Column:
    return F.when(F.array_contains(statuses, "fail"), "fail").when(F.array_contains(statuses, "warn"), "warn").when(F.size(statuses) > 0, "pass")


def badge(score: Column) -> Column:
    return F.when(score >= 0.85, "green").when(score >= 0.60, "orange").when(score > 0, "red").otherwise("not extracted")


def equivalent(a: Column, b: Column, a_number: Column | None = None, b_number: Column | None = None) -> Column:
    """Whether two field values mean the same; each is a text, or a number in the second column of its side.

    Null and empty texts are empty and equal.  Two texts or two numbers are compared as they
    are; a number and a text by the number that the text means without commas and dollar signs.
    """
    an, bn = (F.lit(None).cast("double") if x is None else x.cast("double") for x in (a_number, b_number))
    empty = lambda t, n: n.isNull() & (F.coalesce(t, F.lit("")) == "")
    mixed = lambda t, n: F.coalesce(to_number(t) == n, F.lit(False))
    return (
        F.when(empty(a, an) | empty(b, bn), empty(a, an) & empty(b, bn))
        .when(an.isNotNull() & bn.isNotNull(), an == bn)
        .when(an.isNotNull(), mixed(b, an))
        .when(bn.isNotNull(), mixed(a, bn))
        .otherwise(a == b)
    )


def auto_approved(errors: Column, n_fail: Column, confidences: Column, gate: bool, threshold: float) -> Column:
    least = F.array_min(F.filter(confidences, lambda x: x > 0))
    passes = F.lit(True) if not gate else F.coalesce(least >= threshold, F.lit(True))
    return (F.size(errors) == 0) & (n_fail == 0) & passes


def retry_after(message: Column, cap: int = 60, header: Column | None = None) -> Column:
    """Seconds to wait that an error asks for, by its ``retry-after`` header if it has a number there, else by its message; null if it is no rate limit."""
    both = r"(?iuU)try again in (\d+)m(\d+(?:\.\d+)?)\s*s"
    seconds = r"(?iuU)try again in (\d+(?:\.\d+)?)\s*s"
    plain = r"(?iuUd)retry.{0,15}?(\d+)\s*second"
    number = lambda p, g: F.floor(F.regexp_extract(message, p, g).try_cast("double"))
    bounded = lambda x: F.least(F.lit(cap), F.greatest(F.lit(1), x)).cast("int")
    low = F.lower(message)
    limited = F.contains(low, F.lit("429")) | F.contains(low, F.lit("rate limit")) | F.contains(low, F.lit("resource_exhausted"))
    asked = F.lit(None).cast("double") if header is None else F.when(header.rlike(PY_FLOAT), header.try_cast("double"))
    return (
        F.when(asked.isNotNull(), F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(asked))).cast("int"))
        .when(message.rlike(both), bounded(number(both, 1) * 60 + number(both, 2) + 1))
        .when(message.rlike(seconds), bounded(number(seconds, 1) + 1))
        .when(message.rlike(plain), F.least(F.lit(cap), number(plain, 1)).cast("int"))
        .when(limited, F.lit(15))
    )


def upper_median(values: Column) -> Column:
    """The element after the middle of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
