"""Registered queries over records of every type, their provenance, stores, batches and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sections
from ..operators import batch, catalog, classify, dedup, dispatch, extract, learning, metrics, provenance, quality_scores, replies, templates, validate
from ..sinks import store
from ..sources import pdf
from .more_queries import _pages
from .queries import _query
from .render import discharges, invoices, ndas, table


def _text(n: Column) -> Column:
    return n.cast("string")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _label(label: str, value: Column | str) -> Column:
    return F.concat(F.lit(label + ": "), value if isinstance(value, Column) else F.lit(value))


def _key() -> Column:
    return F.col("o_orderkey")


def _full_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short invoices in which each field has several labels, is filler or is missing, by order key."""
    k = _key()
    text = F.concat_ws(
        "\n",
        F.when(k % 4 == 0, _label("Vendor", "_____")).when(k % 4 == 1, _label("SUPPLIER", F.concat(F.lit("  Acme "), _text(k % 13)))), F.when(k % 4 == 0, _label("From", F.concat(F.lit("Beta "), _text(k % 7)))),
        F.when(k % 3 == 0, _label("Invoice No.", F.concat(F.lit("A-"), _text(k)))).when(k % 3 == 1, F.concat(F.lit("Invoice # B-"), _text(k))),
        F.when(k % 5 == 0, _label("Date", "03/04/2024")).when(k % 5 == 1, _label("Invoice Date", "2024-01-02")),
        F.when(k % 2 == 0, _label("Due Date", "2024/02/03")),
        F.when(k % 6 < 2, _label("Billed To", F.concat(F.lit("Client "), _text(k % 11)))).when(k % 6 == 2, _label("Client", "Zed")),
        F.when(k % 7 == 0, _label("P.O. Number", F.concat(F.lit("PO-"), _text(k % 100)))).when(k % 7 == 1, _label("Purchase Order", "X9")),
        F.when(k % 3 != 0, _label("Payment Terms", F.concat(F.lit("Net "), _text(k % 90)))),
        F.concat(F.lit("SUBTOTAL $"), F.format_number(k % 10000, 0), F.lit(".50")), F.when(k % 8 != 0, F.concat(F.lit("Tax: "), _text(k % 100), F.lit(".25"))),
        F.when(k % 9 == 0, F.concat(F.lit("Freight $"), _text(k % 50))).when(k % 9 == 1, F.lit("Shipping and Handling: 7.5")),
        F.when(k % 10 != 0, F.concat(F.lit("Total: $"), F.format_number(k % 10000 + 1, 0), F.lit(".75"))).otherwise(F.concat(F.lit("Amount Due $"), _text(k % 977), F.lit(".10"))),
        F.when(k % 11 == 0, _label("Currency", "EUR")),
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))


_FULL = """with f as (select o_orderkey, o_orderkey % 10000 as m,
case o_orderkey % 4 when 0 then 'Beta ' || (o_orderkey % 7) when 1 then 'Acme ' || (o_orderkey % 13) end as vendor_name,
case o_orderkey % 3 when 0 then 'A-' || o_orderkey when 1 then 'B-' || o_orderkey end as invoice_number,
case when o_orderkey % 5 = 0 then '03/04/2024' when o_orderkey % 5 = 1 then '2024-01-02' when o_orderkey % 2 = 0 then '2024/02/03' end as invoice_date,
case when o_orderkey % 2 = 0 then '2024/02/03' end as due_date,
case when o_orderkey % 6 < 2 then 'Client ' || (o_orderkey % 11) when o_orderkey % 6 = 2 then 'Zed' end as bill_to,
case o_orderkey % 7 when 0 then 'PO-' || (o_orderkey % 100) when 1 then 'X9' end as po_number,
case when o_orderkey % 3 <> 0 then 'Net ' || (o_orderkey % 90) end as payment_terms,
(o_orderkey % 10000) + 0.5::double as subtotal, case when o_orderkey % 8 <> 0 then (o_orderkey % 100) + 0.25::double end as tax,
case o_orderkey % 9 when 0 then (o_orderkey % 50)::double when 1 then 7.5::double end as shipping_handling,
case when o_orderkey % 10 <> 0 then (o_orderkey % 10000) + 1.75::double else (o_orderkey % 977) + 0.1::double end as total_amount,
case when o_orderkey % 11 = 0 then 'EUR' else 'USD' end as currency from orders)
"""
_FULL_FIELDS = ("vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "po_number", "payment_terms", "subtotal", "tax", "shipping_handling", "total_amount", "currency")


@_query(_FULL + f"select o_orderkey, {', '.join(_FULL_FIELDS)} from f")
def invoice_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_invoices(_full_invoices(spark, sf_dir)).select("o_orderkey", *_FULL_FIELDS)


@_query(_FULL + "select o_orderkey, vendor_name is null or invoice_number is null or invoice_date is null as asks, true as asks_without_lines from f")
def needs_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extract_invoices(_full_invoices(spark, sf_dir)).withColumn("line_items", F.array(F.lit("a line")))
    rows = rows.withColumn("asks", catalog.needs_model(rows, "invoice")).withColumn("line_items", F.array().cast("array<string>"))
    return rows.select("o_orderkey", "asks", catalog.needs_model(rows, "invoice").alias("asks_without_lines"))


@_query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'USD' end as currency,
case when o_orderkey % 2 = 0 then case o_orderkey % 3 when 0 then round(1234.5 + o_orderkey % 100, 2) when 1 then 99.99 end end::double as total_amount,
case when o_orderkey % 4 <> 0 then 'X' || o_orderkey end as invoice_number, case o_orderkey % 5 when 0 then '2024-05-06' when 1 then '05/06/2024' end as invoice_date from orders""")
def infer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    sign = F.when(k % 2 == 0, "$").otherwise("")
    text = F.concat_ws(
        "\n",
        F.when(k % 4 != 0, F.concat(F.lit("inv: X"), _text(k))), F.when(k % 5 == 0, "on 2024-05-06, not 2024-07-08").when(k % 5 == 1, "on 05/06/2024"),
        F.when(k % 3 == 0, F.concat(sign, F.lit("12.00 and "), sign, F.format_number(k % 100 + 1234.5, 2))).when(k % 3 == 1, F.concat(sign, F.lit("99.99"))), F.when(k % 2 == 0, "in $"),
    )
    none = {f: F.lit(None).cast("string") for f in ("currency", "invoice_number", "invoice_date")} | {"total_amount": F.lit(None).cast("double")}
    rows = _orders(spark, sf_dir).select("o_orderkey", text.alias("text")).withColumns(none)
    return extract.infer_invoice_fields(rows).select("o_orderkey", "currency", "total_amount", "invoice_number", "invoice_date")


_LAB_FIELDS = tuple(extract.PATTERNS["lab_report"])


def _lab_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    text = F.concat_ws(
        "\n",
        F.lit("CONFIDENTIAL"), F.concat(F.lit("Lab "), _text(k % 19)),
        F.concat(F.lit("Patient: Ann Lee "), F.when(k % 2 == 0, "DOB: May 5, 1980 (Age 44)").otherwise("MRN: M-1")),
        F.when(k % 3 == 0, F.concat(F.lit("MRN: R-"), _text(k))), F.when(k % 2 == 1, "Date of Birth: 1980-05-05"), F.lit("Gender: F"),
        F.when(k % 4 != 0, F.concat(F.lit("Ordering Physician: Dr. Roy "), F.when(k % 4 == 1, "— Oncology").otherwise("| Cardiology"))),
        F.when(k % 5 != 0, F.concat(F.lit("Accession #: AC-"), _text(k))), F.lit("Specimen Type: Blood"),
        F.when(k % 6 != 0, F.concat(F.lit("Collected: May "), _text(k % 28 + 1), F.lit(", 2024 at 08:10 AM"))), F.concat(F.lit("Reported: June "), _text(k % 9 + 1), F.lit(", 2024 at 9:10 PM")),
        F.when(k % 7 == 0, "CLIA #: 05D"), F.when(k % 8 == 0, F.concat(F.lit("Report ID: LR-"), _text(k))), F.lit("Reviewed & Verified by: Dr. Fox | 2024"),
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))


@_query("""select o_orderkey, 'Ann Lee' as patient_name, case when o_orderkey % 2 = 0 then 'May 5, 1980' else '1980-05-05' end as date_of_birth,
case when o_orderkey % 2 = 1 then 'M-1' when o_orderkey % 3 = 0 then 'R-' || o_orderkey end as mrn, 'F' as gender,
case when o_orderkey % 4 <> 0 then 'Dr. Roy' end as ordering_physician, case o_orderkey % 4 when 0 then null when 1 then 'Oncology' else 'Cardiology' end as ordering_specialty,
case when o_orderkey % 5 <> 0 then 'AC-' || o_orderkey end as accession_number, 'Blood' as specimen_type,
case when o_orderkey % 6 <> 0 then 'May ' || (o_orderkey % 28 + 1) || ', 2024' end as collected_date, 'June ' || (o_orderkey % 9 + 1) || ', 2024' as reported_date, case when o_orderkey % 7 = 0 then '05D' end as clia_number,
case when o_orderkey % 8 = 0 then 'LR-' || o_orderkey when o_orderkey % 5 <> 0 then 'AC-' || o_orderkey end as report_id, 'Dr. Fox' as reviewing_pathologist, 'Lab ' || (o_orderkey % 19) as lab_name from orders""")
def lab_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.record_of(_lab_texts(spark, sf_dir), "lab_report").select("o_orderkey", *_LAB_FIELDS, "lab_name")


@_query("""with p as (select o_orderkey, 1 + (o_orderkey % 6 <> 0)::int * 0 as x from orders)
select o_orderkey, cast(2 as integer) as n_pass, cast(3 as integer) as n_warn, cast(0 as integer) as n_fail, case when o_orderkey % 6 = 0 then 'No date provided.' else 'Date could not be parsed as YYYY-MM-DD or MM/DD/YYYY.' end as collected from p""")
def validate_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.with_checks(dispatch.record_of(_lab_texts(spark, sf_dir), "lab_report"), "lab_report")
    message = F.get(F.filter("checks", lambda c: c["field"] == "collected_date"), F.lit(0))["message"]
    counts = [validate.status_count(F.col("checks"), s).alias(f"n_{s}") for s in ("pass", "warn", "fail")]
    return rows.select("o_orderkey", *counts, message.alias("collected"))


def _business_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    text = F.concat_ws(
        "\n",
        F.when(k % 5 != 0, F.concat(F.lit("Firm "), _text(k % 23), F.lit(" Inc. 1100 Main Road | Page 1"))).otherwise(F.lit("CONFIDENTIAL")),
        F.when(k % 3 == 0, "Period Ending: March 3, 2025 | Final").when(k % 3 == 1, "Date: April 4, 2024"),
        F.when(k % 4 != 0, F.concat(F.lit("Report ID: BR-"), _text(k))), F.when(k % 2 == 0, "Prepared by: Kim Day, CFO"), F.when(k % 7 == 0, "Approved by: Lou | Board"),
        F.lit("Document Classification: Internal | x"),
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))


_BUSINESS = """with b as (select o_orderkey, case when o_orderkey % 3 = 0 then 'March 3, 2025' end as report_period, case o_orderkey % 3 when 0 then 'March 3, 2025' when 1 then 'April 4, 2024' end as report_date,
case when o_orderkey % 4 <> 0 then 'BR-' || o_orderkey end as report_id, case when o_orderkey % 2 = 0 then 'Kim Day' end as prepared_by, case when o_orderkey % 7 = 0 then 'Lou' end as approved_by,
'Internal' as classification, case when o_orderkey % 5 <> 0 then 'Firm ' || (o_orderkey % 23) || ' Inc.' when o_orderkey % 3 = 0 then 'Period Ending: March 3,' when o_orderkey % 3 = 1 then 'Date: April 4,'
when o_orderkey % 4 <> 0 then 'Report ID: BR-' || o_orderkey when o_orderkey % 2 = 0 then 'Prepared by: Kim Day, CFO' end as company_name from orders)
"""


@_query(_BUSINESS + "select o_orderkey, report_period, report_date, report_id, prepared_by, approved_by, classification, company_name from b")
def business_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("report_period", "report_date", "report_id", "prepared_by", "approved_by", "classification", "company_name")
    return dispatch.record_of(_business_texts(spark, sf_dir), "business_doc").select("o_orderkey", *names)


@_query(_BUSINESS + """select o_orderkey, cast(1 + (report_period is not null)::int + (prepared_by is not null)::int as integer) as n_pass,
cast(2 + (report_period is null)::int + (prepared_by is null)::int as integer) as n_warn from b""")
def validate_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.with_checks(dispatch.record_of(_business_texts(spark, sf_dir), "business_doc"), "business_doc")
    return rows.select("o_orderkey", *[validate.status_count(F.col("checks"), s).alias(f"n_{s}") for s in ("pass", "warn")])


@_query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'Rest.' || chr(10) || 'Call ' || (o_orderkey % 10) end as discharge_instructions, case when o_orderkey % 2 = 0 then 'May Day' when o_orderkey % 5 <> 0 then 'Lee' end as treating_physician,
case when o_orderkey % 4 = 0 then '2024-06-07' end as follow_up_date, 'stable' as discharge_condition, '1970-01-02' as date_of_birth, 'Ann Lee' as patient_name from orders""")
def medical_more_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    text = F.concat_ws(
        "\n",
        F.lit("Name: Ann Lee"), F.lit("DOB: 1970-01-02"), F.when(k % 2 == 0, "Attending Physician: May Day").when(k % 5 != 0, "seen by Dr. Lee"),
        F.when(k % 4 == 0, "Follow-up Appointment: 2024-06-07"), F.lit("Condition: stable"),
        F.when(k % 3 == 0, F.concat(F.lit("Discharge Instructions:\n Rest.\nCall "), _text(k % 10), F.lit("\n\nEnd"))),
    )
    rows = dispatch.record_of(_orders(spark, sf_dir).select("o_orderkey", text.alias("text")), "medical_discharge")
    return rows.select("o_orderkey", "discharge_instructions", "treating_physician", "follow_up_date", "discharge_condition", "date_of_birth", "patient_name")


@_query("""with d as (select o_orderkey, o_orderkey % 3 as t from orders join customer on o_custkey = c_custkey)
select case t when 0 then 'nda' when 1 then 'medical_discharge' else 'invoice' end as document_type, field, count(*) as n, count(v) as n_filled from
(select t, unnest(case t when 0 then ['agreement_date', 'effective_date', 'expiration_date', 'disclosing_party', 'receiving_party', 'agreement_type', 'confidentiality_period', 'governing_law', 'permitted_use']
 when 1 then ['facility_name', 'patient_name', 'date_of_birth', 'admission_date', 'discharge_date', 'primary_diagnosis', 'secondary_diagnoses', 'treating_physician', 'discharge_condition', 'discharge_instructions', 'follow_up_date', 'medications']
 else ['vendor_name', 'invoice_number', 'invoice_date', 'due_date', 'bill_to', 'po_number', 'payment_terms', 'subtotal', 'tax', 'shipping_handling', 'total_amount', 'currency', 'line_items'] end) as field,
 case when (t = 0 and field in ('disclosing_party', 'receiving_party', 'agreement_type')) or (t = 1 and field in ('admission_date', 'primary_diagnosis', 'medications')) or (t = 2 and field in ('vendor_name', 'total_amount', 'currency')) then 1 end as v from d)
group by 1, 2""")
def extract_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of text, told apart by their keywords and read by the rules of their type."""
    k = _key()
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("MUTUAL NON-DISCLOSURE\nDisclosing Party: A"), _text(k), F.lit("\nReceiving Party: B")))
        .when(k % 3 == 1, F.lit("Admission Date: 2024-01-02\nPrimary Diagnosis: flu\nMedications: x"))
        .otherwise(F.concat(F.lit("Vendor: Acme\nSubtotal Bill To payment terms\nTotal: $"), _text(k), F.lit(".00")))
    )
    docs = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", text.alias("text"))
    return dispatch.extract_all(docs, "o_orderkey").groupBy("document_type", "field").agg(F.count("*").alias("n"), F.count("value").alias("n_filled"))


def _mode_store(spark: SparkSession) -> DataFrame:
    """Two templates of invoices, without page signatures: texts are matched by their anchors."""
    anchors = lambda a, b: F.create_map(F.lit("vendor_name"), F.lit(a), F.lit("invoice_number"), F.lit(b))
    rows = spark.createDataFrame([(0, "alpha"), (1, "beta")], "ord long, template_name string")
    known = F.when(F.col("ord") == 0, anchors(r"Seller\s*:\s*(?P<value>.+)", r"Ref\s*:\s*(?P<value>\S+)")).otherwise(anchors(r"Shop\s*:\s*(?P<value>.+)", r"Bill\ no\s*:\s*(?P<value>.+)"))
    return rows.select(F.lit("invoice").alias("document_type"), "ord", "template_name", F.array().cast("array<double>").alias("vector"), known.alias("anchors"))


def _mode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("Seller: S"), _text(k % 9), F.lit("\nRef: R"), _text(k)))
        .when(k % 3 == 1, F.concat(F.lit("Shop: T"), _text(k % 9), F.lit("\nTotal: $5.00")))
        .otherwise(F.concat(F.lit("Vendor: V"), _text(k % 9), F.lit("\nInvoice # N"), _text(k)))
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"), F.array().cast("array<double>").alias("vector"))


@_query("""select o_orderkey, case o_orderkey % 3 when 0 then 'S' || (o_orderkey % 9) when 2 then 'V' || (o_orderkey % 9) end as vendor_name,
case o_orderkey % 3 when 0 then 'R' || o_orderkey when 2 then 'N' || o_orderkey end as invoice_number, case o_orderkey % 3 when 0 then 'template' else 'rule-based' end as mode,
case o_orderkey % 3 when 0 then 'Template text anchors filled 2 gap(s): invoice_number, vendor_name.' end as step, case o_orderkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'alpha' end as template_name from orders""")
def adaptive_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.extract_invoice_documents(_mode_texts(spark, sf_dir), _mode_store(spark), "adaptive-local", "o_orderkey")
    step = F.get(F.filter("trace", lambda s: F.contains(s, F.lit("gap(s)"))), F.lit(0))
    return rows.select("o_orderkey", "vendor_name", "invoice_number", classify.effective_mode(F.lit("adaptive-local"), F.col("trace")).alias("mode"), step.alias("step"), "template_name")


@_query("""select o_orderkey, o_orderkey % 3 <> 0 as failed, case when o_orderkey % 3 = 0 then 'S' || (o_orderkey % 9) end as vendor_name, case when o_orderkey % 3 = 0 then 'R' || o_orderkey end as invoice_number from orders""")
def template_only_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.extract_invoice_documents(_mode_texts(spark, sf_dir), _mode_store(spark), "template-only", "o_orderkey")
    return rows.select("o_orderkey", "failed", "vendor_name", "invoice_number")


@_query("select o_orderkey, true as asks from orders")
def model_mode_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text has all required fields, so a model is asked for each."""
    return dispatch.extract_invoice_documents(_mode_texts(spark, sf_dir), _mode_store(spark), "llm-assisted", "o_orderkey").select("o_orderkey", "asks")


@_query("""select o_orderkey, case o_orderkey % 6 when 0 then 'llm-assisted' when 1 then 'template' when 2 then 'template' when 3 then 'rule-based' when 4 then 'rule-based' else 'asked' end as mode from orders""")
def effective_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = (
        ("Matched learned template `a` with score 0.9.", "Used the LLM reasoning layer after incomplete template extraction."), ("Applied learned template anchors to extract fields.",),
        ("Matched learned template `b` with score 1.0.",), ("Fell back to rule-based label and regex extraction.",), ("rule-based label and regex",),
        ("LLM skipped, no template, no rule.",),
    )
    trace = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    return _orders(spark, sf_dir).select("o_orderkey", classify.effective_mode(F.lit("asked"), F.get(trace, (_key() % 6).cast("int"))).alias("mode"))


@_query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'LLM' when o_orderkey % 2 = 0 then 'Spatial' when o_orderkey % 3 = 0 then 'Template' else 'Rule-based' end as a,
case when o_orderkey % 5 = 0 then 'LLM' when o_orderkey % 7 = 0 then 'Cross-validated' else 'Inferred' end as b, case when o_orderkey % 5 = 0 then 'LLM' when o_orderkey % 3 = 0 then 'Template' else 'Rule-based' end as c,
case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 0.88 when o_orderkey % 3 = 0 then 0.82 when o_orderkey % 2 = 0 then 0.78 else 0.75 end::double as baseline, o_orderkey % 5 = 0 as model_used from orders""")
def field_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    trace = F.filter(
        F.array(
            F.when(k % 3 == 0, "Applied learned template anchors to extract fields."), F.lit("Inferred additional fields from semantic heuristics: b, z."),
            F.when(k % 7 == 0, "Cross-validated — multiple methods agree on: b."), F.when(k % 7 == 0, "LLM value differs from prior extraction (LLM used): a."),
            F.when(k % 2 == 0, "Spatial template anchors filled 1 missing field(s) by page position: a."), F.lit("Restored prior extraction values where it returned null: c."),
            F.when(k % 5 == 0, "Used the LLM reasoning layer after incomplete template extraction. Fields extracted: a."),
        ),
        lambda x: x.isNotNull(),
    )
    rows = _orders(spark, sf_dir).select("o_orderkey", trace.alias("trace"))
    sources = provenance.field_sources(F.col("trace"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    rows = rows.select("o_orderkey", sources.alias("s"), provenance.document_baseline(F.col("trace")).alias("baseline"), provenance.model_used(F.col("trace")).alias("model_used"))
    return rows.select("o_orderkey", *[F.col("s")[x].alias(x) for x in "abc"], "baseline", "model_used")


@_query("""select o_orderkey, case o_orderkey % 6 when 4 then null when 0 then case when o_orderkey % 5 = 0 then 'LLM' else 'Manual' end when 1 then 'LLM' when 2 then 'LLM' when 3 then 'Rule-based' when 5 then case when o_orderkey % 5 = 0 then 'LLM' else 'Manual' end end as source,
case o_orderkey % 6 when 4 then null when 0 then case when o_orderkey % 5 = 0 then ':violet[LLM]' else ':green[Manual]' end when 1 then ':violet[LLM]' when 2 then ':violet[LLM]' when 3 then ':gray[Rule-based]' when 5 then case when o_orderkey % 5 = 0 then ':violet[LLM]' else ':green[Manual]' end end as badge from orders""")
def manual_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed values: changed, the same, a number for its text, one that never had a source, emptied, and with outer space."""
    k = _key()
    at = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % 6).cast("int"))
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", at("new", "Acme", None, "Acme", "", " Acme").alias("value"), F.when(k % 6 == 2, 3445.0).alias("number"), at("old", "Acme", "$3,445.00", "Acme", "x", "Acme").alias("original"),
        F.when(k % 6 != 3, "LLM").alias("original_source"), (k % 5 != 0).alias("changed"),
    )
    same = quality_scores.equivalent(F.col("value"), F.col("original"), F.col("number"), None)
    shown = F.coalesce(F.col("value"), F.col("number").cast("string"))
    out = provenance.manual_sources(rows.withColumn("same", same).withColumn("value", shown), F.col("same"))
    return out.select("o_orderkey", "source", provenance.source_badge(F.col("source")).alias("badge"))


@_query("""select o_orderkey, case o_orderkey % 10 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then false when 5 then true when 6 then true when 7 then false when 8 then true when 9 then true end as same from orders""")
def value_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both empty, a blank text beside nothing, equal and unlike texts, spaces, and numbers beside texts and numbers."""
    texts = [("", None), (" ", None), ("Acme", "Acme"), ("  Acme ", "Acme"), ("3,445.00", "$3445.00"), (" $3,445.00 ", None), (None, "3445"), (None, "n/a"), (None, None), ("1_000", None)]
    numbers = [(None, None), (None, None), (None, None), (None, None), (None, None), (None, 3445.0), (3445.0, None), (3445.0, None), (2.5, 2.5), (None, 1000.0)]
    at = lambda xs, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in xs]), (_key() % 10).cast("int"))
    (a, b), (an, bn) = ([at([x[i] for x in rows], kind) for i in (0, 1)] for rows, kind in ((texts, "string"), (numbers, "double")))
    return _orders(spark, sf_dir).select("o_orderkey", quality_scores.equivalent(a, b, an, bn).alias("same"))


@_query("""select o_orderkey, case o_orderkey % 4 when 0 then case when o_orderkey % 3 = 0 then 0.88 when o_orderkey % 3 = 1 then 0.66 else 0.308 end when 1 then case when o_orderkey % 3 = 0 then 0.78 when o_orderkey % 3 = 1 then 0.585 else 0.273 end
when 2 then case when o_orderkey % 3 = 0 then 0.75 when o_orderkey % 3 = 1 then 0.562 else 0.262 end else case when o_orderkey % 3 = 0 then 0.95 when o_orderkey % 3 = 1 then 0.712 else 0.332 end end::double as confidence from orders""")
def baseline_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a source, of an unknown one and of a known one, under baselines of their documents."""
    k = _key()
    source = F.when(k % 4 == 3, "Manual").when(k % 4 == 2, "Guess")
    baseline = F.when(k % 4 == 0, 0.88).when(k % 4 == 1, 0.78).otherwise(0.75)
    worst = F.when(k % 3 == 1, "warn").when(k % 3 == 2, "fail")
    return _orders(spark, sf_dir).select("o_orderkey", quality_scores.field_confidence(source, worst, F.lit(False), baseline).alias("confidence"))


@_query("""select o_orderkey, case when o_orderkey % 8 = 0 then false when o_orderkey % 8 = 1 then false when o_orderkey % 8 = 2 then false when o_orderkey % 8 = 3 then false when o_orderkey % 8 = 4 then true when o_orderkey % 8 = 5 then false else true end as learn,
case o_orderkey % 8 when 0 then 'Skipped learning because template-only mode is read-only.' when 1 then 'Template learning is disabled for this run.' when 2 then 'Skipped automatic template learning for llm-assisted extraction until a user approves the result.'
when 3 then 'Skipped template learning because approved data is still missing required fields.' when 4 then 'Bypassed normal learning threshold because the user explicitly approved the result.' when 5 then 'Skipped template learning because pass ratio 0.25 is below 0.60.' end as step,
case when o_orderkey % 8 = 5 then 0.25 when o_orderkey % 8 = 3 then 0.5 when o_orderkey % 8 = 7 then 0.0 else 1.0 end::double as ratio from orders where o_orderkey % 8 <> 7
union all select o_orderkey, false, 'Skipped template learning because pass ratio 0.00 is below 0.60.', 0.0 from orders where o_orderkey % 8 = 7""")
def learning_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key() % 8
    check = lambda field, status: F.struct(F.lit(field).alias("field"), F.lit(status).alias("status"), F.lit("").alias("message"))
    good = F.array(check("disclosing_party", "pass"), check("receiving_party", "pass"), check("agreement_date", "pass"))
    half = F.array(check("disclosing_party", "pass"), check("receiving_party", "pass"), check("agreement_date", "fail"), check("governing_law", "warn"))
    quarter = F.array(check("disclosing_party", "pass"), check("receiving_party", "fail"), check("agreement_date", "fail"), check("governing_law", "warn"))
    checks = F.when(k == 3, half).when(k == 5, quarter).when(k == 7, F.filter(good, lambda c: F.lit(False))).otherwise(good)
    rows = _orders(spark, sf_dir).select("o_orderkey", checks.alias("checks")).withColumn("ratio", learning.pass_ratio(F.col("checks")))
    gate = learning.learning_gate(
        F.when(k == 0, "template-only").otherwise("llm-assisted"), k != 1, k.isin(3, 4), k != 2, F.col("ratio"), catalog.required_pass(F.col("checks"), F.lit("nda"))
    )
    return rows.select("o_orderkey", gate.alias("g"), "ratio").select("o_orderkey", "g.learn", "g.step", "ratio")


@_query(r"""select o_orderkey, 'Seller Name\s*:\s*(?P<value>.+)' as vendor_pattern, case when o_orderkey % 2 = 0 then 'N' || o_orderkey end as number_found, 'V' || (o_orderkey % 9) as vendor_found, case when o_orderkey % 2 = 0 then 2 else 1 end as n_anchors from orders""")
def text_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors learnt of a record, and what they find in the text again; a number inside a longer value gets none."""
    k = _key()
    text = F.concat(F.lit("Seller Name: V"), _text(k % 9), F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("Invoice Number: N"), _text(k), F.lit(" Due Date: 2024-01-02"))).otherwise(F.concat(F.lit("about N"), _text(k))))
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    record = F.array(pair("document_type", F.lit("invoice")), pair("vendor_name", F.concat(F.lit("v"), _text(k % 9))), pair("invoice_number", F.concat(F.lit("N"), _text(k))), pair("due_date", F.lit("")))
    rows = _orders(spark, sf_dir).select("o_orderkey", text.alias("text"), record.alias("record")).withColumn("sections", sections(F.col("text")))
    rows = learning.with_text_anchors(rows)
    found = templates.anchor_values(F.col("anchors"), F.col("text"))
    return rows.select(
        "o_orderkey", F.replace(F.col("anchors")["vendor_name"], F.lit("\\ "), F.lit(" ")).alias("vendor_pattern"), found["invoice_number"].alias("number_found"), found["vendor_name"].alias("vendor_found"),
        F.size("anchors").alias("n_anchors"),
    )


@_query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'bill_to:unknown:0.0:0.1625,' else '' end || 'invoice_number:invoice number:0.0:0.0113,po_number:po number:0.0:0.0113' || case when o_orderkey % 4 <> 0 then ',vendor_name:vendor:0.0:0.1625' else '' end as anchors from orders""")
def spatial_anchor_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of labelled rows that hold the record's values, then of rows that hold a value under a label that names no other field."""
    k = _key()
    record = F.create_map(
        F.lit("invoice_number"), F.concat(F.lit("inv-"), _text(k)), F.lit("po_number"), F.concat(F.lit("PO-"), _text(k % 100)), F.lit("vendor_name"), F.concat(F.lit("Acme-"), _text(k % 50)),
        F.lit("bill_to"), F.concat(F.lit("acme-"), _text(k % 50)), F.lit("subtotal"), F.lit("US"), F.lit("payment_terms"), F.lit("Net 30"),
    )
    page = F.col("rows")
    rows = _pages(spark, sf_dir).select("o_orderkey", "rows", record.alias("record"))
    rows = rows.withColumn("record", F.map_filter("record", lambda f, _: (k % 4 == 0) & (f != "vendor_name") | (k % 4 != 0) & (f != "bill_to")))
    out = learning.spatial_anchors(page, F.lit(600.0), F.lit(800.0), F.col("record"))
    shown = F.array_join(F.array_sort(F.transform(out, lambda a: F.concat_ws(":", a["field"], a["label_text"], a["norm_x"].cast("string"), a["norm_y"].cast("string")))), ",")
    return rows.select("o_orderkey", shown.alias("anchors"))


@_query(r"""with recursive e as (select label, vec_id, embedding::double[] as v, row_number() over (partition by label order by vec_id) as k from embeddings),
s as (select a.label, a.vec_id, a.k, list(round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 4) order by b.k) as sims from e a join e b using (label) group by 1, 2, 3),
t as (select label, 0::bigint as k, []::bigint[] as slots from (select distinct label from e)
union all select t.label, s.k, case when len(slots) > 0 and (list_max(list_transform(slots, lambda x: sims[x])) >= 0.85 or len(slots) >= 20)
 then list_transform(range(1, len(slots) + 1), lambda i: case when i = list_position(list_transform(slots, lambda x: sims[x]), list_max(list_transform(slots, lambda x: sims[x]))) then s.k else slots[i] end)
 else list_append(slots, s.k) end from t join s on s.label = t.label and s.k = t.k + 1),
l as (select label, slots, row_number() over (partition by label order by k desc) as r from t), u as (select label, unnest(slots) as k, unnest(range(0, len(slots))) as slot from l where r = 1)
select u.label, cast(slot as integer) as slot, e.vec_id from u join e on e.label = u.label and e.k = u.k""")
def template_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings learnt as a template of its label, by id: merged, given a slot, or put in place of the most similar."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("document_type"), F.col("vec_id").alias("ord"), _text(F.col("vec_id")).alias("template_name"), F.col("embedding").cast("array<double>").alias("vector"),
        F.create_map().cast("map<string,string>").alias("anchors"), F.array().cast("array<struct<field:string,label_text:string,norm_x:double,norm_y:double>>").alias("spatial_anchors"),
    )
    return learning.learn_templates(rows).select(F.col("document_type").cast("int").alias("label"), "slot", F.col("ord").alias("vec_id"))


@_query(r"""select document_type, field, pattern from (values ('invoice', 'vendor_name', '^\s*_+\s*$'), ('invoice', 'vendor_name', '^\s*N\/A\ \(none\)\s*$'), ('nda', 'x', '^old$'), ('nda', 'x', '^\s*\.+\s*$')) t(document_type, field, pattern)""")
def bad_pattern_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("nda", "x", "^old$"), ("invoice", "vendor_name", r"^\s*_+\s*$")], "document_type string, field string, pattern string")
    rejected = [("invoice", "vendor_name", "___"), ("invoice", "vendor_name", " N/A (none) "), ("invoice", "vendor_name", "  "), ("invoice", "vendor_name", None), ("nda", "x", "."), ("nda", "x", "..")]
    return learning.add_patterns(known, spark.createDataFrame(rejected, "document_type string, field string, value string"))


@_query("""select c_custkey, case when c_custkey % 7 = 0 then '__' when c_custkey % 4 = 0 or c_custkey % 10 = 1 then null else c_name end as value, c_custkey % 7 <> 0 and (c_custkey % 4 = 0 or c_custkey % 10 = 1) as cleared from customer""")
def bad_pattern_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a pattern clears, with white space around, others, a field that is never cleared; a pattern that does not compile is ignored."""
    key = F.col("c_custkey")
    value = F.when(key % 7 == 0, "__").when(key % 4 == 0, "  _____ ").when(key % 10 == 1, "n/a (NONE)").otherwise(F.col("c_name"))
    field = F.when(key % 7 == 0, "source_file").otherwise("vendor_name")
    fields = table(spark, sf_dir, "customer").select("c_custkey", F.lit("invoice").alias("document_type"), field.alias("field"), value.alias("value"))
    kinds = [("vendor_name", "___"), ("vendor_name", "N/A (none)"), ("source_file", "_")]
    rejected = spark.createDataFrame(kinds, "field string, value string").select(F.lit("invoice").alias("document_type"), "field", "value")
    broken = spark.createDataFrame([("invoice", "vendor_name", "([")], "document_type string, field string, pattern string")
    return templates.clear_bad_values(fields, learning.add_patterns(broken, rejected)).select("c_custkey", "value", "cleared")
