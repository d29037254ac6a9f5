"""Tables and blocks in the text of lab reports and business documents.

Texts that are null have no blocks (null) and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import FLAGS, PY_FLOAT, block, let, lines_of, sections, strip

#: Lines that are no test, no metric, no subtype; headers that bound the metrics.
LAB_SKIP = ("test", "result", "units", "reference range", "flag", "reference", "")
KPI_SKIP = ("metric", "current period", "prior period", "variance", "status", "")
SUBTYPE_SKIP = ("EXECUTIVE SUMMARY", "KEY PERFORMANCE INDICATORS", "STRATEGIC RECOMMENDATIONS")
KPI_HEADER = "KEY PERFORMANCE INDICATORS"
KPI_ENDS = ("STRATEGIC RECOMMENDATIONS", "EXECUTIVE SUMMARY")
KPI_INLINE = r"([A-Za-z][A-Za-z\s()%$]+?)\s+([\d,./]+)\s+([\d,./]+)\s+([+\-][\d,.%]+(?:\s*pts?)?)(?=\s+[A-Za-z(]|\z)"
KPI_STATUS = r"^(?:Strong|On\s+Track|Moderate|Weak|Below\s+Target|On\s+[Tt]arget)\s+"
SUBTYPE = r"^([A-Z][A-Z ]+?)(?=\s+[A-Za-z][a-z]|\s+\d|\||\s*$)"


def _walk(items: Column, take, made: str, jump):
    """Fold that emits ``made(item)`` and skips ``jump(item)`` items where ``take(item)`` holds, else moves on by one."""
    empty = F.struct(F.lit(0).alias("skip"), F.slice(F.transform(items, made), 1, 0).alias("out"))

    def step(acc, x):
        moved = F.struct((acc["skip"] - 1).alias("skip"), acc["out"].alias("out"))
        hit = F.struct((jump(x) - 1).alias("skip"), F.concat(acc["out"], F.array(made(x))).alias("out"))
        return F.when(acc["skip"] > 0, moved).when(take(x), hit).otherwise(acc)

    return F.aggregate(items, empty, step, lambda acc: acc["out"])


def clinical_interpretation(text: Column) -> Column:
    return strip(block(text, r"CLINICAL\s+INTERPRETATION[^\n]*\n(.*?)(?:\nReviewed|\z)"))


def lab_panels(text: Column) -> Column:
    """Array of test, value, units, reference_range and flag (both empty): a line, then a number, then its units."""

    def panels(ls):
        rows = F.transform(ls, lambda x, i: F.struct(x.alias("test"), F.get(ls, i + 1).alias("value"), F.coalesce(F.get(ls, i + 2), F.lit("")).alias("units"), F.lit("").alias("reference_range"), F.lit("").alias("flag")))
        skipped = lambda r: F.lower(r["test"]).isin(*LAB_SKIP) | ((r["test"] == F.upper(r["test"])) & (F.length(r["test"]) > 4))
        number = lambda r: F.coalesce(F.replace(r["value"], F.lit(","), F.lit("")).rlike(PY_FLOAT), F.lit(False))
        return _walk(rows, lambda r: ~skipped(r) & number(r), lambda r: r, lambda r: F.lit(3))

    return let(lines_of(text), panels)


def document_subtype(text: Column) -> Column:
    """The first line after the company's whose leading words are in capitals."""
    content = F.filter(sections(text), lambda x: ~x.startswith("CONFIDENTIAL"))
    names = F.transform(content, lambda x, i: F.when(i > 0, strip(F.regexp_extract(x, SUBTYPE, 1))))
    good = F.filter(names, lambda x: (F.length(x) > 6) & ~x.isin(*SUBTYPE_SKIP))
    return F.initcap(F.lower(F.get(good, F.lit(0))))


def executive_summary(text: Column) -> Column:
    found = block(text, r"EXECUTIVE\s+SUMMARY[\s\n](.*?)(?=\n[A-Z][A-Z ]{4,}(?:\n|\s)|\z)")
    return strip(F.regexp_replace(found, r"(?U)\s+", " "))


def kpi_lines(text: Column) -> Column:
    """Lines between the header of the metrics and the next header, without table heads."""

    def tail(ls):
        at = F.array_position(F.transform(ls, F.upper), KPI_HEADER).cast("int")
        return F.when(at > 0, F.slice(ls, at + 1, F.size(ls))).otherwise(F.slice(ls, 1, 0))

    def head(ls):
        ends = F.transform(ls, lambda x: F.upper(x).isin(*KPI_ENDS) | x.startswith("CONFIDENTIAL"))
        at = F.array_position(ends, True).cast("int")
        return F.when(at > 0, F.slice(ls, F.lit(1), at - 1)).otherwise(ls)

    kept = let(let(sections(text), tail), head)
    return F.filter(kept, lambda x: ~F.lower(x).isin(*KPI_SKIP) & (F.upper(x) != KPI_HEADER))


def _kpi(metric, current, prior, variance) -> Column:
    return F.struct(metric.alias("metric"), current.alias("current_period"), prior.alias("prior_period"), variance.alias("variance"))


def _inline_kpis(line: Column) -> Column:
    groups = [F.regexp_extract_all(line, F.lit("(?iuU)" + KPI_INLINE), F.lit(g)) for g in range(1, 5)]
    rows = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "mcpv", strict=True)])
    named = F.transform(rows, lambda r: _kpi(strip(F.regexp_replace(r["m"], FLAGS + KPI_STATUS, "")), r["c"], r["p"], strip(r["v"])))
    return F.filter(named, lambda r: r["metric"] != "")


def kpis(text: Column) -> Column:
    """Array of metric, current and prior period and variance; entries on single lines if no entry spans lines."""

    def table(ls):
        rows = F.transform(ls, lambda x, i: F.struct(x.alias("m"), *[F.get(ls, i + k).alias(f"l{k}") for k in range(1, 5)]))
        number = lambda r: F.regexp_replace(r["l1"], "[,%/]", "").rlike(PY_FLOAT)
        status = lambda r: F.coalesce(~r["l4"].rlike(r"(?U)^\d"), F.lit(False))
        stacked = _walk(
            rows, lambda r: r["l3"].isNotNull() & number(r), lambda r: _kpi(r["m"], r["l1"], r["l2"], r["l3"]), lambda r: F.when(status(r), 5).otherwise(4)
        )
        return let(stacked, lambda s: F.when(F.size(s) > 0, s).otherwise(F.flatten(F.transform(ls, _inline_kpis))))

    return let(kpi_lines(text), table)


def recommendations(text: Column) -> Column:
    """Numbered items of their section, or of the text if it has no such section."""
    inside = block(text, r"STRATEGIC\s+RECOMMENDATIONS\s*\n(.*?)(?:CONFIDENTIAL|\z)")
    parts = F.filter(F.transform(F.split(inside, r"(?U)\d+\.\s+"), strip), lambda x: F.length(x) > 10)
    loose = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?Ud)\d+\.\s+(.{20,}?)(?=\s+\d+\.|\s*$)"), F.lit(1))
    return F.when(inside.isNotNull(), F.transform(parts, lambda x: F.regexp_replace(x, "[. ]+$", ""))).otherwise(loose)
