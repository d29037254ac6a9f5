"""Typed records out of texts by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLAGS, first_match, money, sections, strip

MONEY_FIELDS = ("subtotal", "tax", "shipping_handling", "total_amount")

#: Field patterns of each document type, tried in this order.
PATTERNS = {
    "invoice": {
        "vendor_name": [r"Vendor\s*:\s*(?P<value>.+)", r"Supplier\s*:\s*(?P<value>.+)", r"From\s*:\s*(?P<value>.+)"],
        "invoice_number": [r"Invoice\s*(?:Number|No\.?)\s*:\s*(?P<value>[\w\-]+)", r"Invoice\s*#\s*(?P<value>[\w\-]+)"],
        "invoice_date": [r"Invoice\s*Date\s*:\s*(?P<value>[\d/\-]+)", r"Date\s*:\s*(?P<value>[\d/\-]+)"],
        "due_date": [r"Due\s*Date\s*:\s*(?P<value>[\d/\-]+)"],
        "bill_to": [r"Bill\s*To\s*:\s*(?P<value>.+)", r"Billed\s*To\s*:\s*(?P<value>.+)", r"Customer\s*:\s*(?P<value>.+)", r"Client\s*:\s*(?P<value>.+)"],
        "po_number": [r"P\.?O\.?\s*(?:Number|No\.?|#)\s*:\s*(?P<value>[\w\-]+)", r"Purchase\s+Order\s*(?:Number|No\.?|#)?\s*:\s*(?P<value>[\w\-]+)"],
        "payment_terms": [r"Payment\s+Terms\s*:\s*(?P<value>.+)", r"Terms\s*:\s*(?P<value>(?:Net\s*\d+|Due\s+on\s+[Rr]eceipt|[Cc][Oo][Dd]|.{3,40}))"],
        "subtotal": [r"Subtotal\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)"],
        "tax": [r"Tax\s*(?:Rate)?\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)"],
        "shipping_handling": [r"Shipping\s*(?:&|and)?\s*Handling\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)", r"Shipping\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)", r"Freight\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)", r"S\s*&\s*H\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)"],
        "total_amount": [r"(?<![A-Za-z])Total\s*:\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)", r"(?<![A-Za-z])Total\s+\$(?P<value>[\d,]+(?:\.\d{1,2})?)", r"Amount\s*Due\s*:?\s*\$?(?P<value>[\d,]+(?:\.\d{1,2})?)"],
        "currency": [r"Currency\s*:\s*(?P<value>[A-Z]{3})"],
    },
    "medical_discharge": {
        "facility_name": [r"(?:Hospital|Clinic|Medical Center|Health System)\s*:\s*(?P<value>.+)"],
        "patient_name": [r"Patient\s*(?:Name)?\s*:\s*(?P<value>[A-Za-z ,]+)", r"Name\s*:\s*(?P<value>[A-Za-z ,]+)"],
        "date_of_birth": [r"(?:Date\s*of\s*Birth|DOB)\s*:\s*(?P<value>[\d/\-]+)"],
        "admission_date": [r"(?:Admission|Admitted|Admit)\s*Date\s*:\s*(?P<value>[\d/\-]+)", r"Date\s*(?:of\s*)?Admission\s*:\s*(?P<value>[\d/\-]+)"],
        "discharge_date": [r"Discharge\s*Date\s*:\s*(?P<value>[\d/\-]+)", r"Date\s*(?:of\s*)?Discharge\s*:\s*(?P<value>[\d/\-]+)"],
        "primary_diagnosis": [r"Primary\s*Diagnosis\s*:\s*(?P<value>.+)", r"Diagnosis\s*:\s*(?P<value>.+)", r"Principal\s*Diagnosis\s*:\s*(?P<value>.+)"],
        "treating_physician": [r"(?:Treating|Attending|Discharge)\s*Physician\s*:\s*(?P<value>.+)", r"Physician\s*:\s*(?P<value>.+)", r"Dr\.?\s*(?P<value>[A-Za-z ,]+)"],
        "discharge_condition": [r"(?:Discharge\s*)?Condition\s*:\s*(?P<value>.+)", r"Condition\s*(?:at\s*Discharge)?\s*:\s*(?P<value>.+)"],
        "follow_up_date": [r"Follow[\s\-]*[Uu]p\s*(?:Date|Appointment)?\s*:\s*(?P<value>[\d/\-]+)"],
    },
    "nda": {
        "agreement_date": [r"(?:Agreement|Effective)\s*Date\s*:\s*(?P<value>[\w ,]+\d{4})", r"dated\s+(?:as\s+of\s+)?(?P<value>[\w ,]+\d{4})"],
        "effective_date": [r"Effective\s*Date\s*:\s*(?P<value>[\w ,]+\d{4})"],
        "expiration_date": [r"(?:Expir|Terminat|End)\s*(?:ation)?\s*Date\s*:\s*(?P<value>[\w ,]+\d{4})", r"(?:shall\s+expire|expires)\s+on\s+(?P<value>[\w ,]+\d{4})"],
        "disclosing_party": [r"Disclosing\s*Party\s*:\s*(?P<value>[^\n\)]+)", r'"Discloser"\s*(?:means|shall mean)\s+(?P<value>[^\n,]+)', r"""(?P<value>[A-Za-z][\w\s,\.]+?)\s*\(?["']?Disclosing\s*Party["']?\)?"""],
        "receiving_party": [r"Receiving\s*Party\s*:\s*(?P<value>[^\n\)]+)", r'"Recipient"\s*(?:means|shall mean)\s+(?P<value>[^\n,]+)', r"""(?P<value>[A-Za-z][\w\s,\.]+?)\s*\(?["']?Receiving\s*Party["']?\)?"""],
        "governing_law": [r"governed\s+by\s+(?:the\s+laws?\s+of\s+)?(?P<value>[^\n,.]+)", r"Governing\s*Law\s*:\s*(?P<value>[^\n]+)"],
        "confidentiality_period": [r"(?:period|term)\s+of\s+(?P<value>\d+\s*(?:year|month|day)s?)", r"(?:for\s+a\s+period\s+of\s+)(?P<value>\d+\s*(?:year|month|day)s?)"],
    },
    "lab_report": {
        "patient_name": [r"Patient\s*:\s*(?P<value>[A-Za-z][A-Za-z ,\.]+?)(?:\s+DOB|\s+MRN|\s*$)"],
        "date_of_birth": [r"DOB\s*:\s*(?P<value>[A-Za-z0-9 ,]+?)(?:\s+\(Age|\s*$)", r"Date\s+of\s+Birth\s*:\s*(?P<value>[A-Za-z0-9 ,/\-]+)"],
        "mrn": [r"MRN\s*:\s*(?P<value>[\w\-]+)"],
        "gender": [r"Gender\s*:\s*(?P<value>\w+)"],
        "ordering_physician": [r"Ordering\s+Physician\s*:\s*(?P<value>[^\n\u2014]+?)(?:\s*[\u2014\|]|\s*$)"],
        "ordering_specialty": [r"Ordering\s+Physician\s*:[^\u2014\|]+[\u2014\|]\s*(?P<value>[^\n]+)"],
        "accession_number": [r"Accession\s*#\s*:\s*(?P<value>[\w\-]+)"],
        "specimen_type": [r"Specimen\s+Type\s*:\s*(?P<value>[^\n]+)"],
        "collected_date": [r"Collected\s*:\s*(?P<value>[A-Za-z0-9 ,]+?)(?:\s+at\s+[\d:]+\s*[AP]M|\s*$)"],
        "reported_date": [r"Reported\s*:\s*(?P<value>[A-Za-z0-9 ,]+?)(?:\s+at\s+[\d:]+\s*[AP]M|\s*$)"],
        "clia_number": [r"CLIA\s*#?\s*:\s*(?P<value>[\w]+)"],
        "report_id": [r"Report\s+ID\s*:\s*(?P<value>[\w\-]+)", r"Accession\s*#\s*:\s*(?P<value>[\w\-]+)"],
        "reviewing_pathologist": [r"Reviewed\s*(?:&|and)\s*Verified\s+by\s*:\s*(?P<value>[^|\n]+?)(?:\s*\||\s*$)"],
    },
    "business_doc": {
        "report_period": [r"Period\s+Ending\s*:\s*(?P<value>[^\|\n]+)"],
        "report_id": [r"Report\s+ID\s*:\s*(?P<value>[\w\-]+)"],
        "report_date": [r"(?:Date|Dated)\s*:\s*(?P<value>[A-Za-z0-9 ,]+\d{4})", r"Period\s+Ending\s*:\s*(?P<value>[A-Za-z0-9 ,]+\d{4})"],
        "prepared_by": [r"Prepared\s+by\s*:\s*(?P<value>[^\n,]+)"],
        "approved_by": [r"Approved\s+by\s*:\s*(?P<value>[a-zA-Z][^\|\n]*?)(?:\s*\||\s*$)"],
        "classification": [r"Document\s+Classification\s*:\s*(?P<value>[^\|\n]+)"],
    },
}

#: A line item, its header words, and lines that are no vendor.
LINE_ITEM = r"^([A-Za-z][^\n]{2,60}?)\s+(\d+)\s+\$?([\d,]+\.\d{2})\s+\$?([\d,]+\.\d{2})\s*$"
LINE_ITEM_HEADERS = ("item", "description", "product", "service", "qty", "quantity")
NOT_A_VENDOR = (
    r"^\s*(?:invoice|bill\s*to|billed\s*to|ship\s*to|date|due\s*date|po\s*(?:number|no|#)|payment|purchase\s*order|subtotal|total|tax"
    r"|shipping|amount\s*due|from\s*:|vendor\s*:|supplier\s*:|customer\s*:|client\s*:|terms\s*:|currency\s*:|\d)"
)


def extract_fields(docs: DataFrame, document_type: str, text_col: str = "text") -> DataFrame:
    """Adds one string column for each field of a type; null where no pattern gives a usable value."""
    return docs.withColumns({f: first_match(docs[text_col], p) for f, p in PATTERNS[document_type].items()})


def line_items(text: Column) -> Column:
    """Array of description, quantity, unit price and total of the lines that look like items."""
    groups = [F.regexp_extract_all(text, F.lit("(?Udm)" + LINE_ITEM), F.lit(g)) for g in range(1, 5)]
    rows = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "dqut", strict=True)])
    items = F.transform(
        rows,
        lambda r: F.struct(
            strip(r["d"]).alias("description"),
            r["q"].try_cast("int").alias("quantity"),
            money(r["u"]).alias("unit_price"),
            money(r["t"]).alias("total"),
        ),
    )
    return F.filter(items, lambda r: ~F.lower(r["description"]).isin(*LINE_ITEM_HEADERS))


def unlabelled_vendor(text: Column) -> Column:
    """The first line that could be a company name, if the text is marked as an invoice."""
    lines = F.slice(sections(text), 1, 8)
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(FLAGS + r"\b(?:INVOICE|RECEIPT|STATEMENT)\b")), True)
    head = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    names = F.filter(
        head, lambda x: ~x.rlike(FLAGS + NOT_A_VENDOR) & ~F.contains(x, F.lit("@")) & F.length(x).between(3, 100)
    )
    return F.when(text.rlike(r"(?Ud)\b(?:INVOICE|Invoice\s*#|Invoice\s*Number)\b"), F.get(names, F.lit(0)))


def extract_invoices(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Invoice fields, money as numbers beside their raw text, and line items; the currency is USD unless told."""
    rows = extract_fields(docs, "invoice", text_col)
    found = {"vendor_name": F.coalesce("vendor_name", unlabelled_vendor(F.col(text_col))), "currency": F.coalesce("currency", F.lit("USD"))}
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"{f}_raw": F.col(f) for f in MONEY_FIELDS}).withColumns({f: money(F.col(f)) for f in MONEY_FIELDS})
    return rows.withColumn("line_items", line_items(F.col(text_col)))


def infer_invoice_fields(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Fills missing currency, total, number and date of invoices from looser patterns."""
    text = F.col(text_col)
    amounts = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(r"\$\s*([\d,]+\.\d{2})"), F.lit(1)), money), lambda x: x.isNotNull()
    )
    number = F.regexp_extract(text, FLAGS + r"\b(?:INV|Invoice)[-\s#:]*(\w+)\b", 1)
    date = F.regexp_extract(text, r"(?U)\b(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})\b", 1)
    return rows.withColumns(
        {
            "currency": F.coalesce("currency", F.when(F.contains(text, F.lit("$")), "USD")),
            "total_amount": F.coalesce("total_amount", F.array_max(amounts)),
            "invoice_number": F.coalesce("invoice_number", F.when(number != "", number)),
            "invoice_date": F.coalesce("invoice_date", F.when(date != "", date)),
        }
    )


def medications(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?iuUds)Medications?\s*:(.*?)(?:\n\n|\z)", 1)
    lines = F.transform(F.split(block, "\r?\n"), lambda x: F.regexp_replace(x, "^[ \\-•\t]+|[ \\-•\t]+$", ""))
    return F.filter(lines, lambda x: x != "")


def discharge_instructions(text: Column) -> Column:
    block = strip(F.regexp_extract(text, r"(?iuUds)Discharge\s*Instructions?\s*:(.*?)(?:\n\n|\z)", 1))
    return F.when(block != "", block)


def agreement_type(text: Column) -> Column:
    low = F.lower(text)
    one_way = F.contains(low, F.lit("one-way")) | F.contains(low, F.lit("one way")) | F.contains(low, F.lit("unilateral"))
    return F.when(F.contains(low, F.lit("mutual")), "mutual").when(one_way, "one-way")


def lab_name(text: Column) -> Column:
    return F.get(F.filter(sections(text), lambda x: ~x.startswith("CONFIDENTIAL")), F.lit(0))


def company_name(text: Column) -> Column:
    first = strip(F.split(lab_name(text), r"\|")[0])
    bare = strip(F.regexp_replace(first, r"(?U)\s+\d{3,}[\d\s,.\w]*$", ""))
    return F.when(bare != "", bare).otherwise(first)


def fill_gaps(a: Column, b: Column) -> Column:
    """A value, or another where it is empty."""
    return F.coalesce(F.when(a != "", a), b)
