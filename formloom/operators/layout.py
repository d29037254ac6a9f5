"""Label and value pairs of pages, from rows of words, as Catalyst expressions.

A page is an array of rows ``struct<text, x0, x1, top, words>``, see ``page_rows``.
Null pages have no pairs.  Where a label repeats, the docstrings say which one counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .spatial import cluster_rows

#: Fields of labels.
FIELD_OF_LABEL = {
    "invoice number": "invoice_number", "invoice no": "invoice_number", "invoice #": "invoice_number", "inv #": "invoice_number",
    "inv no": "invoice_number", "invoice date": "invoice_date", "date of invoice": "invoice_date", "issue date": "invoice_date",
    "date": "invoice_date", "due date": "due_date", "payment due": "due_date", "due": "due_date", "net 30": "due_date",
    "vendor": "vendor_name", "vendor name": "vendor_name", "supplier": "vendor_name", "supplier name": "vendor_name",
    "bill from": "vendor_name", "sold by": "vendor_name", "from": "vendor_name", "company": "vendor_name",
    "subtotal": "subtotal", "sub total": "subtotal", "sub-total": "subtotal", "tax": "tax", "sales tax": "tax", "gst": "tax",
    "vat": "tax", "hst": "tax", "shipping": "shipping_handling", "shipping & handling": "shipping_handling",
    "shipping and handling": "shipping_handling", "freight": "shipping_handling", "handling": "shipping_handling",
    "total": "total_amount", "total amount": "total_amount", "amount due": "total_amount", "balance due": "total_amount",
    "grand total": "total_amount", "total due": "total_amount", "currency": "currency", "po number": "po_number",
    "purchase order": "po_number", "purchase order number": "po_number", "bill to": "bill_to", "customer": "bill_to",
    "ship to": "ship_to", "patient name": "patient_name", "patient": "patient_name", "patient id": "patient_name",
    "admission date": "admission_date", "admitted": "admission_date", "date admitted": "admission_date",
    "discharge date": "discharge_date", "discharged": "discharge_date", "date discharged": "discharge_date",
    "diagnosis": "primary_diagnosis", "primary diagnosis": "primary_diagnosis", "admitting diagnosis": "primary_diagnosis",
    "date of birth": "date_of_birth", "dob": "date_of_birth", "physician": "attending_physician",
    "attending physician": "attending_physician", "follow up date": "follow_up_date", "follow-up date": "follow_up_date",
    "disclosing party": "disclosing_party", "receiving party": "receiving_party", "agreement date": "agreement_date",
    "effective date": "effective_date", "expiration date": "expiration_date", "governing law": "governing_law",
    "agreement type": "agreement_type", "collected": "collected_date", "collection date": "collected_date",
    "specimen collected": "collected_date", "reported": "reported_date", "report date": "reported_date",
    "date reported": "reported_date", "ordering physician": "ordering_physician", "company name": "company_name",
    "prepared by": "prepared_by", "approved by": "approved_by", "report period": "report_period", "period": "report_period",
    "period ending": "report_period", "reporting period": "report_period", "report id": "report_id",
    "document type": "document_subtype", "document classification": "classification", "classification": "classification",
}
MIN_GAP, MAX_LABEL_WORDS = 20, 5

#: A known label right before a colon.  No label holds a colon, so the leftmost match at a colon is the longest label's.
_KNOWN = r"(?iud)(?:^|(?<=\s))(" + "|".join(re.escape(x) for x in FIELD_OF_LABEL) + r")\s*:(?=\s|$)"
_PAIRS = "array<struct<label:string,value:string>>"


def page_rows(words: Column) -> Column:
    """Rows of a page from its words, each row sorted by x."""

    def row(ws):
        by_x = F.transform(F.array_sort(F.transform(ws, lambda w, i: F.struct(w["x0"].alias("x"), i.alias("i"), w.alias("w")))), lambda s: s["w"])
        return let(by_x, lambda s: F.struct(
            F.array_join(F.transform(s, lambda w: w["text"]), " ").alias("text"), F.element_at(s, 1)["x0"].alias("x0"),
            F.element_at(s, -1)["x1"].alias("x1"), F.array_min(F.transform(s, lambda w: w["top"])).alias("top"), s.alias("words"),
        ))

    return F.transform(cluster_rows(words), row)


def normalise_label(label: Column) -> Column:
    bare = strip(F.regexp_replace(F.lower(strip(label)), ":+$", ""))
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def normalised(x: Column, size: Column) -> Column:
    """A coordinate as a share of the page's size, 0 where the page has none."""
    return F.coalesce(F.when(size != 0, F.round(x / size, 4)), F.lit(0.0))


def field_of(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FIELD_OF_LABEL.items() for x in pair])
    return F.element_at(known, label)


def _pair(label: Column, value: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"))


def _one_each(pairs: Column, at: int) -> Column:
    """One pair of each label in order of first mention: its first (1) or its last (-1)."""
    return let(pairs, lambda ps: F.transform(
        F.array_distinct(F.transform(ps, lambda p: p["label"])),
        lambda name: _pair(name, F.element_at(F.filter(ps, lambda p: p["label"] == name), at)["value"]),
    ))


def colon_pair(text: Column) -> Column:
    """Label and value around the first colon of a row, as an array of one or none."""
    p = r"(?d)^(.+?)\s*:\s*(.+)\s*$"

    def pairs(t):
        pair = _pair(normalise_label(F.regexp_extract(t, p, 1)), strip(F.regexp_extract(t, p, 2)))
        return F.when(F.contains(t, F.lit(":")), F.filter(F.array(pair), lambda x: (x["label"] != "") & (x["value"] != ""))).otherwise(F.array().cast(_PAIRS))

    return let(strip(text), pairs)


def several_pairs(text: Column) -> Column:
    """Pairs of a row with two known labels or more, else none; a repeated label's last value counts."""

    def pairs(t):
        labels = F.transform(F.regexp_extract_all(t, F.lit(_KNOWN), F.lit(1)), normalise_label)
        values = let(F.split(t, _KNOWN), lambda vs: F.transform(F.slice(vs, F.lit(2), F.size(vs)), strip))
        several = let(labels, lambda ls: F.when(F.size(ls) >= 2, F.filter(F.zip_with(ls, values, _pair), lambda x: x["value"].rlike("[a-zA-Z0-9]"))))
        # Each label has a colon of its own: most rows have fewer than two and need no search.
        return F.coalesce(F.when(t.like("%:%:%"), several), F.array().cast(_PAIRS))

    return _one_each(let(strip(text), pairs), -1)


def row_pairs(text: Column) -> Column:
    """All pairs of a row's text: several, or the one around a colon."""
    return let(several_pairs(text), lambda m: F.when(F.size(m) > 0, m).otherwise(colon_pair(text)))


def gap_pairs(rows: Column) -> Column:
    """Known labels of few words with a wide gap to the value; a repeated label's last value counts."""

    def of_row(r):
        ws, n = r["words"], F.size(r["words"])
        gaps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(ws, i)["x0"] - F.get(ws, i - 1)["x1"] >= MIN_GAP)
        joined = lambda part: F.array_join(F.transform(part, lambda w: w["text"]), " ")
        pair = let(F.get(gaps, F.lit(0)), lambda i: F.when(
            (n >= 2) & ~F.contains(r["text"], F.lit(":")) & (i <= MAX_LABEL_WORDS),
            _pair(normalise_label(joined(F.slice(ws, F.lit(1), i))), strip(joined(F.slice(ws, i + 1, n)))),
        ))
        return pair

    found = F.filter(F.transform(rows, of_row), lambda p: p.isNotNull() & (p["value"] != "") & field_of(p["label"]).isNotNull())
    return _one_each(found, -1)


def stacked_pairs(rows: Column) -> Column:
    """Known labels alone on a row, the value on the next row at a like x; a repeated label's last value counts."""
    only = r"(?d)^(.+?)\s*:\s*$"

    def below(r, i):
        nxt, text = F.get(rows, i + 1), strip(r["text"])
        value = strip(nxt["text"])
        near = F.abs(nxt["x0"] - r["x0"]) < r["x1"] * 0.15
        return F.when(text.rlike(only) & near & (value != "") & ~value.rlike(only), _pair(normalise_label(F.regexp_extract(text, only, 1)), value))

    found = F.filter(F.transform(rows, below), lambda p: p.isNotNull() & field_of(p["label"]).isNotNull())
    return _one_each(found, -1)


def fields_from_pages(pages: Column) -> Column:
    """Map of field to value over all pages: a label's first value counts, then a field's last label."""
    of_page = lambda rows: F.concat(F.flatten(F.transform(rows, lambda r: row_pairs(r["text"]))), gap_pairs(rows), stacked_pairs(rows))
    firsts = _one_each(F.flatten(F.transform(pages, of_page)), 1)
    fields = F.filter(F.transform(firsts, lambda p: _pair(field_of(p["label"]), p["value"])), lambda p: p["label"].isNotNull())
    return F.map_from_entries(_one_each(fields, -1))


def fields_by_anchors(rows: Column, width: Column, height: Column, anchors: Column, x_tol: float = 0.10, y_tol: float = 0.04) -> Column:
    """Map of field to value at stored places of the first page.

    ``anchors`` holds ``struct<field, label_text, norm_x, norm_y>``.  The first row near an
    anchor counts that has its label, or any row near one without a label.
    """

    def near(r, a):
        return (F.abs(r["x"] - a["norm_x"]) <= x_tol) & (F.abs(r["y"] - a["norm_y"]) <= y_tol)

    def value(a, r):
        label = F.coalesce(a["label_text"], F.lit(""))
        exact = F.get(F.filter(r["pairs"], lambda p: p["label"] == label), F.lit(0))["value"]
        there = (label == "") | F.contains(r["lower"], F.lower(label))
        return F.when(near(r, a), F.when((label != "") & exact.isNotNull(), exact).when(there, r["first"]))

    def read(r):
        first = lambda ps: F.coalesce(F.get(ps, F.lit(0))["value"], strip(r["text"]))
        return let(row_pairs(r["text"]), lambda ps: F.struct(r["x"].alias("x"), r["y"].alias("y"), F.lower(r["text"]).alias("lower"), ps.alias("pairs"), first(ps).alias("first")))

    def values(read_rows):
        return F.transform(anchors, lambda a: _pair(a["field"], F.get(F.filter(F.transform(read_rows, lambda r: value(a, r)), lambda v: v.isNotNull()), F.lit(0))))

    # A row is read once, for all anchors, and only if one of them is near.
    placed = F.transform(rows, lambda r: F.struct(normalised(r["x0"], width).alias("x"), normalised(r["top"], height).alias("y"), r["text"].alias("text")))
    found = let(F.transform(F.filter(placed, lambda r: F.exists(anchors, lambda a: near(r, a))), read), values)
    return F.map_from_entries(_one_each(F.filter(found, lambda p: (p["label"] != "") & p["value"].isNotNull()), -1))
