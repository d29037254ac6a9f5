"""Learning from accepted records: anchors of a template, its place in the store, and rejected values.

The store holds at most ``templates.CAP`` templates of a type; the store's names are taken
to be unique within a type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .layout import FIELD_OF_LABEL, colon_pair, field_of, normalised, row_pairs
from .templates import CAP, bad_pattern, similarity

#: Fields that are never anchored, the shortest value that a page is searched for, and the usual least share of passed checks.
NOT_ANCHORED = ("document_type", "source_file")
LEAST_VALUE = 3
LEAST_PASSED = 0.6

_LABELS: dict[str, list[str]] = {}
for _label, _field in FIELD_OF_LABEL.items():
    _LABELS.setdefault(_field, []).append(_label)

TEMPLATE = (
    "document_type string, ord bigint, template_name string, vector array<double>, anchors map<string,string>,"
    " spatial_anchors array<struct<field:string,label_text:string,norm_x:double,norm_y:double>>"
)


def line_label(line: Column) -> Column:
    """The text before a line's first colon; empty without one."""
    return F.when(F.contains(line, F.lit(":")), strip(F.substring_index(line, ":", 1))).otherwise("")


def _patterns(field: str, line: str) -> Iterator[tuple[str, str]]:
    """(label, pattern) that may anchor a field on a line: the label before the first colon, then the field's known labels,
    whose value ends where the next label starts."""
    head, colon, _ = line.partition(":")
    if colon and head.strip():
        yield head.strip(), rf"{re.escape(head.strip())}\s*:\s*(?P<value>.+)"
    for label in _LABELS.get(field, ()):
        name = re.escape(label)
        if re.search(rf"(?:^|\s){name}\s*:", line, re.IGNORECASE):
            #: Fixed value: the form of a bounded pattern, as templates store it.
            yield label, rf"(?<![:\w]){name}\s*:\s*(?P<value>[^\n]*?)(?=\s+[A-Z#][\w\s#-]*\s*:|\n|\Z)"


def text_anchors(values: dict[str, str], lines: list[str]) -> dict[str, tuple[str, str]]:
    """(label, pattern) by field: the first pattern, not used before, that finds just the field's value on a line that holds it."""
    anchors: dict[str, tuple[str, str]] = {}
    for field, value in values.items():
        wanted = (value or "").strip().lower()
        if not wanted or field in NOT_ANCHORED:
            continue
        used = {pattern for _, pattern in anchors.values()}
        tries = (x for line in map(str.strip, lines) if wanted in line.lower() for x in ((line, *p) for p in _patterns(field, line)))
        for line, label, pattern in tries:
            found = None if pattern in used else re.search(pattern, line, re.IGNORECASE)
            if found and found["value"].strip().lower() == wanted:
                anchors[field] = (label, pattern)
                break
    return anchors


def with_text_anchors(rows: DataFrame, record: str = "record", lines: str = "sections", out: str = "anchors") -> DataFrame:
    """Adds the anchors (field to pattern) of records, ``record`` an array of (field, value) in their order, ``lines`` of the text.

    Which pattern a field gets hangs on those before it, so a record is handled as a whole, in Arrow batches.
    """

    @F.pandas_udf("map<string,string>")
    def learn(records: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([
            {f: p for f, (_, p) in text_anchors({x["field"]: x["value"] for x in (r if r is not None else [])}, list(t) if t is not None else []).items()}
            for r, t in zip(records, texts, strict=True)
        ])

    return rows.withColumn(out, learn(F.col(record), F.col(lines)))


def spatial_anchors(rows: Column, width: Column, height: Column, record: Column) -> Column:
    """Anchors ``struct<field, label_text, norm_x, norm_y>`` of a first page's rows for a record, a map of field to text.

    First the rows whose label names a field of the record and whose value and the record's
    hold one another.  Then, for fields without one, the first row that holds the value: its
    label counts unless it names another field; without a label there is no anchor.
    """
    anchor = lambda f, label, r: F.struct(
        f.alias("field"), label.alias("label_text"), normalised(r["x0"], width).alias("norm_x"), normalised(r["top"], height).alias("norm_y")
    )

    def labelled(rs: Column) -> Column:
        def of_row(r: Column) -> Column:
            def fits(p: Column) -> Column:
                value = F.lower(strip(F.coalesce(F.element_at(record, field_of(p["label"])), F.lit("None"))))
                known = F.coalesce(F.array_contains(F.map_keys(record), field_of(p["label"])), F.lit(False))
                return known & (value != "") & (F.contains(F.lower(p["value"]), value) | F.contains(value, F.lower(p["value"])))

            return F.transform(F.filter(row_pairs(r["text"]), fits), lambda p: anchor(field_of(p["label"]), p["label"], r))

        found = F.flatten(F.transform(rs, of_row))
        return let(found, lambda xs: F.transform(F.array_distinct(F.transform(xs, lambda x: x["field"])), lambda f: F.element_at(F.filter(xs, lambda x: x["field"] == f), 1)))

    def scanned(rs: Column, firsts: Column) -> Column:
        names = F.array_except(F.map_keys(record), F.concat(F.transform(firsts, lambda x: x["field"]), F.array(*[F.lit(x) for x in NOT_ANCHORED])))

        def of_field(f: Column) -> Column:
            value = F.lower(strip(F.element_at(record, f)))

            def of_row(r: Column) -> Column:
                label = F.get(colon_pair(r["text"]), F.lit(0))["label"]
                other = F.coalesce(field_of(label) != f, F.lit(False))
                return F.when(label.isNotNull() & ~other, anchor(f, label, r))

            holding = F.filter(rs, lambda r: F.contains(F.lower(r["text"]), value))
            return F.when(F.length(value) >= LEAST_VALUE, let(F.get(holding, F.lit(0)), of_row))

        return F.filter(F.transform(names, of_field), lambda x: x.isNotNull())

    return let(rows, lambda rs: let(labelled(rs), lambda firsts: F.concat(firsts, scanned(rs, firsts))))


def pass_ratio(checks: Column) -> Column:
    """Share of checks that passed, 0 without checks."""
    passed = F.size(F.filter(checks, lambda c: c["status"] == "pass"))
    return F.when(F.size(checks) > 0, passed / F.size(checks)).otherwise(F.lit(0.0))


def learning_gate(mode: Column, enabled: Column, forced: Column, automatic: Column, ratio: Column, required: Column, least: float = LEAST_PASSED) -> Column:
    """Struct of ``learn`` and ``step``: whether a result may teach a template, and what its trace says of that."""
    verdict = lambda learn, step: F.struct(F.lit(learn).alias("learn"), F.lit(step).cast("string").alias("step") if not isinstance(step, Column) else step.alias("step"))
    low = F.concat(F.lit("Skipped template learning because pass ratio "), F.format_string("%.2f", ratio), F.lit(f" is below {least:.2f}."))
    return (
        F.when(mode == "template-only", verdict(False, "Skipped learning because template-only mode is read-only."))
        .when(~enabled, verdict(False, "Template learning is disabled for this run."))
        .when(~forced & ~automatic, verdict(False, "Skipped automatic template learning for llm-assisted extraction until a user approves the result."))
        .when(forced & ~required, verdict(False, "Skipped template learning because approved data is still missing required fields."))
        .when(forced, verdict(True, "Bypassed normal learning threshold because the user explicitly approved the result."))
        .when(ratio < least, verdict(False, low))
        .otherwise(verdict(True, None))
    )


def learn_templates(templates: DataFrame, cap: int = CAP, merge: float = 0.85) -> DataFrame:
    """The store after learning ``templates`` (columns of ``TEMPLATE``) one by one, by ord, with a slot for each.

    One at least ``merge`` similar to the first most similar of its type takes that one's
    slot and name, and keeps its spatial anchors for fields it has none of.  Else it gets a
    slot, or the slot of the first most similar one where its type has ``cap``.  Each step
    hangs on those before it, so a type is read in order by one task, which holds ``cap``
    templates at a time.
    """
    names = [c.split()[0] for c in TEMPLATE.split(", ")]

    def run(batches):
        kind, store = None, []
        for batch in batches:
            for values in zip(*[batch[c] for c in names], strict=True):
                new = dict(zip(names, values, strict=True))
                if store and new["document_type"] != kind:
                    yield pd.DataFrame([x | {"slot": i} for i, x in enumerate(store)])
                    store = []
                kind = new["document_type"]
                scores = [similarity(new["vector"], x["vector"]) for x in store]
                best = scores.index(max(scores)) if scores else None
                if best is not None and scores[best] >= merge:
                    old = store[best]
                    mine = list(new["spatial_anchors"]) if new["spatial_anchors"] is not None else []
                    fields = {a["field"] for a in mine}
                    kept = [a for a in (old["spatial_anchors"] if old["spatial_anchors"] is not None else []) if a["field"] not in fields]
                    store[best] = new | {"template_name": old["template_name"], "spatial_anchors": kept + mine or None}
                elif len(store) >= cap:
                    store[best] = new
                else:
                    store.append(new)
        if store:
            yield pd.DataFrame([x | {"slot": i} for i, x in enumerate(store)])

    ordered = templates.select(*names).repartition("document_type").sortWithinPartitions("document_type", "ord")
    return ordered.mapInPandas(run, TEMPLATE + ", slot int")


def learn_signatures(rows: DataFrame, merge: float = 0.92, cap: int = 1_000) -> DataFrame:
    """template_name, ord: the store of text signatures after learning ``rows(ord, template_name, signature)`` one by one.

    A signature at least ``merge`` similar to the first most similar one takes its place
    under its name.  The store is one sequence, held by one task; beyond ``cap`` templates it raises.
    """
    from .templates import signature_score

    def run(batches):
        store = []
        for batch in batches:
            for number, name, signature in zip(batch["ord"], batch["template_name"], batch["signature"], strict=True):
                scores = [signature_score(signature, x[2]) for x in store]
                best = scores.index(max(scores)) if scores else None
                if best is not None and scores[best] >= merge:
                    store[best] = (number, store[best][1], signature)
                elif len(store) >= cap:
                    raise ValueError(f"more than {cap} text templates")
                else:
                    store.append((number, name, signature))
        yield pd.DataFrame({"template_name": [x[1] for x in store], "ord": [x[0] for x in store]})

    ordered = rows.select("ord", "template_name", "signature").coalesce(1).sortWithinPartitions("ord")
    return ordered.mapInPandas(run, f"template_name string, ord {rows.schema['ord'].dataType.simpleString()}")


def add_patterns(store: DataFrame, rejected: DataFrame) -> DataFrame:
    """The store of bad patterns (document_type, field, pattern) with those of ``rejected(document_type, field, value)``; blank values give none."""
    new = rejected.select("document_type", "field", bad_pattern(F.col("value")).alias("pattern")).filter("pattern is not null")
    return store.select("document_type", "field", "pattern").union(new).distinct()
