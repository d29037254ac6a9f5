"""Where a field's value comes from, read from the steps of a trace or told by typed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip

#: Phrases of traces, and the source each of them stands for.
REPLACED = "llm reasoning layer after incomplete template"
UNSEEN = "llm reasoning layer for an unseen"
TEMPLATE_STEPS = ("applied learned template", "used learned template anchors")
REVIEWED = "human-reviewed corrections"
GAP = r"(?iuUd)^(.+?)\s+filled\s+\d+\s+\S+.*?:\s*(.+)\.$"
INFERRED = r"(?iuUd)^inferred additional fields from semantic heuristics:\s*(.+)\.$"
RESTORED = "restored prior extraction values"
MODEL_STEPS = ("llm reasoning layer", "used openai", "used gemini", "used anthropic", "used ollama")
#: Colour of each source.
COLOURS = {"Cross-validated": "green", "LLM": "violet", "Template": "blue", "Spatial": "blue", "Rule-based": "gray", "Inferred": "orange", "Manual": "green"}

_EVENT = "struct<kind:string,method:string,fields:array<string>>"


def _has(low: Column, *phrases: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def _names(text: Column) -> Column:
    return F.transform(F.split(text, ","), strip)


def _event(kind: str, method: Column | str | None = None, fields: Column | None = None) -> Column:
    method = method if isinstance(method, Column) else F.lit(method).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), method.alias("method"), (fields if fields is not None else F.array().cast("array<string>")).alias("fields")
    ).cast(_EVENT)


def _event_of(step: Column) -> Column:
    """What a step of a trace says: a reset, a primary method, or a source of some fields."""

    def read(s: Column) -> Column:
        low = F.lower(s)
        label = F.lower(F.regexp_extract(s, GAP, 1))
        method = F.when(_has(label, "spatial"), "Spatial").when(_has(label, "template"), "Template").when(_has(label, "rule"), "Rule-based").otherwise(strip(F.regexp_extract(s, GAP, 1)))
        after_colon = F.regexp_replace(strip(F.regexp_replace(s, r"(?s)^[^:]*:", "")), r"\.+$", "")
        after_used = F.regexp_replace(strip(F.regexp_replace(s, r"(?s)^.*?\(llm used\):", "")), r"\.+$", "")
        return (
            F.when(_has(low, REPLACED), _event("reset"))
            .when(_has(low, UNSEEN), _event("model"))
            .when(_has(low, *TEMPLATE_STEPS), _event("template"))
            .when(_has(low, REVIEWED), _event("none"))
            .when(s.rlike(GAP), _event("fields", method, _names(F.regexp_extract(s, GAP, 2))))
            .when(s.rlike(INFERRED), _event("fields", "Inferred", _names(F.regexp_extract(s, INFERRED, 1))))
            .when(low.startswith("cross-validated"), _event("fields", "Cross-validated", _names(after_colon)))
            .when(_has(low, RESTORED), _event("none"))
            .when(low.startswith("llm value differs"), _event("fields", "LLM", _names(after_used)))
            .otherwise(_event("none"))
        )

    return let(step, read)


def field_sources(trace: Column, present: Column) -> Column:
    """Map of field to source: what the last step that names a field says, and the primary method for other present fields.

    ``present`` is the array of names of fields that have a value.  Steps before the last
    one by which a model replaced a template's result do not count.
    """

    def of_events(events: Column) -> Column:
        last_reset = F.array_max(F.transform(events, lambda e, i: F.when(e["kind"] == "reset", i + 1).otherwise(0)))
        told = F.flatten(
            F.transform(
                F.slice(events, F.coalesce(last_reset, F.lit(0)) + 1, F.greatest(F.size(events), F.lit(1))),
                lambda e: F.when(e["kind"] == "fields", F.transform(e["fields"], lambda f: F.struct(f.alias("k"), e["method"].alias("v")))).otherwise(
                    F.array().cast("array<struct<k:string,v:string>>")
                ),
            )
        )
        default = (
            F.when(F.exists(events, lambda e: e["kind"].isin("reset", "model")), "LLM")
            .when(F.exists(events, lambda e: e["kind"] == "template"), "Template")
            .otherwise("Rule-based")
        )

        def merged(ts: Column) -> Column:
            names = F.array_distinct(F.transform(ts, lambda t: t["k"]))
            last = F.transform(names, lambda n: F.struct(n.alias("k"), F.element_at(F.filter(ts, lambda t: t["k"] == n), -1)["v"].alias("v")))
            others = F.transform(F.array_except(present, names), lambda n: F.struct(n.alias("k"), default.alias("v")))
            return F.map_from_entries(F.concat(last, others))

        return let(told, merged)

    return let(F.transform(F.coalesce(trace, F.array().cast("array<string>")), _event_of), of_events)


def document_baseline(trace: Column) -> Column:
    """Confidence that a trace as a whole gives a field without a source of its own."""
    low = F.lower(F.array_join(F.coalesce(trace, F.array().cast("array<string>")), " "))
    return let(
        low,
        lambda x: F.when(_has(x, "llm", "openai", "groq"), 0.88).when(_has(x, "learned template", "applied"), 0.82).when(_has(x, "spatial"), 0.78)
        .when(_has(x, "rule-based", "regex"), 0.72).otherwise(0.75),
    )


def model_used(trace: Column) -> Column:
    """Whether any step says that a model was used."""
    return F.coalesce(F.exists(trace, lambda s: _has(F.lower(s), *MODEL_STEPS)), F.lit(False))


def manual_sources(rows: DataFrame, same: Column) -> DataFrame:
    """Adds ``source`` to reviewed long rows ``(value, original_source, changed, …)``.

    A value that differs from the original one is Manual where the review changed anything at
    all (``changed``); others keep their source, Rule-based if they have none; empty ones get none.
    """
    kept = F.coalesce("original_source", F.lit("Rule-based"))
    source = F.when(F.col("changed") & ~same, "Manual").otherwise(kept)
    return rows.withColumn("source", F.when(F.coalesce(F.col("value"), F.lit("")) != "", source))


def source_colour(source: Column) -> Column:
    out = F.lit("gray")
    for name, colour in COLOURS.items():
        out = F.when(source == name, colour).otherwise(out)
    return out


def source_badge(source: Column) -> Column:
    return F.concat(F.lit(":"), source_colour(source), F.lit("["), source, F.lit("]"))


def gap_step(filled: Column, source: str = "Rule-based extraction") -> Column:
    """The step that tells of filled gaps, null if there were none."""
    n = F.size(filled)
    return F.when(n > 0, F.concat(F.lit(f"{source} filled "), n.cast("string"), F.lit(" gap(s): "), F.array_join(F.array_sort(filled), ", "), F.lit(".")))


def position_step(filled: Column) -> Column:
    """The step that tells of fields filled by position, null if there were none."""
    n = F.size(filled)
    text = F.concat(F.lit("Spatial template anchors filled "), n.cast("string"), F.lit(" missing field(s) by page position: "), F.array_join(F.array_sort(filled), ", "), F.lit("."))
    return F.when(n > 0, text)


def inference_step(inferred: Column) -> Column:
    """The step that tells of inferred fields."""
    named = F.concat(F.lit("Inferred additional fields from semantic heuristics: "), F.array_join(F.array_sort(inferred), ", "), F.lit("."))
    return F.when(F.size(inferred) > 0, named).otherwise("No additional missing fields could be inferred.")


def gaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that ``a`` has empty and ``b`` has not; fields that ``a`` does not know are left out."""
    missing = lambda v: v.isNull() | (v.cast("string") == "")
    names = [F.when(missing(a[f]) & ~missing(v), f) for f, v in b.items() if f in a]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
