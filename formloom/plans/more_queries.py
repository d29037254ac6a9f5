"""Registered queries over reports, page layouts, model replies and batch summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, replies, reports, summaries, templates
from .queries import _query
from .render import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


def _text(n) -> F.Column:
    return n.cast("string")


def _labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lab report for each order; every third lacks its second result, every fourth its interpretation."""
    k = F.col("o_orderkey")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Lab "), _text(k % 19)), F.lit("CHEMISTRY PANEL"), F.lit("Test"), F.lit("Result"), F.lit("Units"),
        F.lit("Sodium"), _text(k % 90 + 100), F.lit("mmol/L"), F.lit(""),
        F.when(k % 3 != 0, F.concat(F.lit("Iron\n1,"), _text(k % 900 + 100), F.lit("\nug"))),
        F.when(k % 4 != 0, F.concat(F.lit("Clinical Interpretation:\n  Case "), _text(k), F.lit("\n is plain.\nReviewed by Dr. X"))),
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))


@_query("""select o_orderkey, cast(case when o_orderkey % 3 <> 0 then 2 else 1 end as integer) as n_panels, (o_orderkey % 90 + 100)::varchar as first_value,
case when o_orderkey % 3 <> 0 then 'Iron=1,' || (o_orderkey % 900 + 100) || ' ug' end as second_panel,
case when o_orderkey % 4 <> 0 then 'Case ' || o_orderkey || chr(10) || ' is plain.' end as interpretation from orders""")
def lab_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = _labs(spark, sf_dir).select("o_orderkey", reports.lab_panels(text).alias("p"), reports.clinical_interpretation(text).alias("interpretation"))
    second = F.get("p", F.lit(1))
    return rows.select(
        "o_orderkey", F.size("p").alias("n_panels"), F.get("p", F.lit(0))["value"].alias("first_value"),
        F.concat(second["test"], F.lit("="), second["value"], F.lit(" "), second["units"]).alias("second_panel"), "interpretation",
    )


def _memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A business document for each order; every fifth has its metrics on one line, every seventh no recommendations' header."""
    k = F.col("o_orderkey")
    table_rows = F.concat(F.lit("Metric\nCurrent Period\nPrior Period\nRevenue\n"), _text(k % 50), F.lit(".5\n40.0\n+2%\nStrong\nMargin\n29\n26\n+3 pts"))
    one_line = F.concat(F.lit("Revenue "), _text(k % 50), F.lit(".5 40.0 +2% Strong Margin 29 26 +3 pts"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Company "), _text(k % 23), F.lit(" Inc. 1100 Main Road | Confidential")), F.lit("STRATEGIC BRIEFING Period Ending: March 3, 2025"),
        F.lit("EXECUTIVE SUMMARY"), F.concat(F.lit("Year  "), _text(k), F.lit(" was good.")),
        F.lit("KEY PERFORMANCE INDICATORS"), F.when(k % 5 == 0, one_line).otherwise(table_rows),
        F.when(k % 7 != 0, "STRATEGIC RECOMMENDATIONS"), F.concat(F.lit("1. Expand the sales team of region "), _text(k % 9), F.lit(" now. 2. Cut the costs of all travel.")),
        F.lit("CONFIDENTIAL"),
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))


@_query("""select o_orderkey, 'Strategic Briefing' as subtype, 'Year ' || o_orderkey || ' was good.' as summary,
2::integer as n_kpis, 'Revenue:' || (o_orderkey % 50) || '.5' as first_kpi, 'Margin:+3 pts' as second_kpi,
'Expand the sales team of region ' || (o_orderkey % 9) || ' now' || case when o_orderkey % 7 = 0 then '.' else '' end as first_recommendation from orders""")
def business_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, those without the recommendations' header too."""
    return _business(_memos(spark, sf_dir))


def _business(memos: DataFrame) -> DataFrame:
    text = F.col("text")
    rows = memos.select(
        "o_orderkey", reports.document_subtype(text).alias("subtype"), reports.executive_summary(text).alias("summary"),
        reports.kpis(text).alias("k"), reports.recommendations(text).alias("r"),
    )
    kpi = lambda i, f: F.concat(F.get("k", F.lit(i))["metric"], F.lit(":"), F.get("k", F.lit(i))[f])
    return rows.select(
        "o_orderkey", "subtype", "summary", F.size("k").alias("n_kpis"), kpi(0, "current_period").alias("first_kpi"), kpi(1, "variance").alias("second_kpi"),
        F.get("r", F.lit(0)).alias("first_recommendation"),
    )


@_query("""select o_orderkey, 'Expand the sales team of region ' || (o_orderkey % 9) || ' now.' as recommendation, 1::integer as n from orders where o_orderkey % 7 = 0""")
def loose_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memos(spark, sf_dir).filter("o_orderkey % 7 = 0").select("o_orderkey", reports.recommendations(F.col("text")).alias("r"))
    return rows.select("o_orderkey", F.get("r", F.lit(0)).alias("recommendation"), F.size("r").alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of words for each order: rows with several pairs, a colon, a gap and a stacked pair."""
    k = F.col("o_orderkey")
    word = lambda text, x0, x1, y: F.struct(
        text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(y)).alias("top"), F.lit(float(x1)).alias("x1"), F.lit(y + 10.0).alias("bottom")
    )
    words = F.array(
        word(F.lit("Invoice"), 0, 40, 10), word(F.lit("Number:"), 45, 90, 11), word(F.concat(F.lit("INV-"), _text(k)), 100, 150, 10),
        word(F.lit("PO"), 160, 180, 10), word(F.lit("Number:"), 185, 220, 9), word(F.concat(F.lit("PO-"), _text(k % 100)), 230, 260, 10),
        word(F.when(k % 4 == 0, "Unknown:").otherwise("Vendor:"), 0, 40, 130), word(F.concat(F.lit("Acme-"), _text(k % 50)), 50, 80, 130),
        word(F.lit("Currency"), 0, 50, 250), word(F.lit("USD"), 100, 130, 250),
        word(F.lit("Due"), 0, 20, 370), word(F.lit("Date:"), 25, 60, 370),
        word(F.lit("2024-01-02"), 1, 60, 490),
    )
    # Orders are small and pages costly: a file of one row group would be one task, however many orders it has.
    orders = _orders(spark, sf_dir).select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return orders.select("o_orderkey", layout.page_rows(words).alias("rows"))


@_query("""select o_orderkey, 'INV-' || o_orderkey as invoice_number, 'PO-' || (o_orderkey % 100) as po_number, case when o_orderkey % 4 <> 0 then 'Acme-' || (o_orderkey % 50) end as vendor_name,
'USD' as currency, '2024-01-02' as due_date from orders""")
def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("o_orderkey", layout.fields_from_pages(F.array("rows")).alias("f"))
    return rows.select("o_orderkey", *[F.col("f")[n].alias(n) for n in ("invoice_number", "po_number", "vendor_name", "currency", "due_date")])


@_query("""select o_orderkey, case when o_orderkey % 4 <> 0 then 'Acme-' || (o_orderkey % 50) end as vendor_name, 'Currency USD' as currency, 'PO-' || (o_orderkey % 100) as po_number from orders""")
def layout_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields at stored places: with a label, without one, among several pairs, and too far off (due_date)."""
    places = (("vendor_name", "vendor", 0.0, 0.1625), ("currency", "", 0.05, 0.3), ("po_number", "po number", 0.0, 0.0), ("due_date", "due date", 0.5, 0.4625))
    anchors = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("label_text"), F.lit(x).alias("norm_x"), F.lit(y).alias("norm_y")) for f, t, x, y in places])
    found = layout.fields_by_anchors(F.col("rows"), F.lit(600.0), F.lit(800.0), anchors)
    # A filter would be pushed below the fields, which then would be found twice.
    rows = _pages(spark, sf_dir).select("o_orderkey", F.explode(F.filter(F.array(found), lambda f: f["due_date"].isNull())).alias("f"))
    return rows.select("o_orderkey", *[F.col("f")[n].alias(n) for n in ("vendor_name", "currency", "po_number")])


@_query("""select o_orderkey, case o_orderkey % 3 when 0 then 'Acme' when 1 then 'Beta' end as vendor_name, case when o_orderkey % 3 <> 2 then o_orderkey % 100 end::integer as total from orders""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fenced = F.concat(F.lit('```json\n{"vendor_name": "Acme", "total": '), _text(k % 100), F.lit(', "other": 1}\n```'))
    chatty = F.concat(F.lit('Here you are: {"vendor_name": "Beta", "total": '), _text(k % 100), F.lit("} Bye."))
    reply = F.when(k % 3 == 0, fenced).when(k % 3 == 1, chatty).otherwise("I cannot tell.")
    rows = _orders(spark, sf_dir).select("o_orderkey", replies.parse_reply(reply, "vendor_name string, total int").alias("r"))
    return rows.select("o_orderkey", "r.vendor_name", "r.total")


@_query("""select o_orderkey, case when o_orderkey % 4 < 2 then 'Acme' when o_orderkey % 4 = 2 then 'beta' end as value,
case when o_orderkey % 4 = 3 then 'none' when o_orderkey % 4 = 2 then 'restored' when o_orderkey % 4 = 0 then 'cross-validated' when o_orderkey % 8 = 1 then 'override' else 'model' end as outcome from orders""")
def merge_model_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    model = F.when(k % 4 < 2, "Acme").when(k % 4 == 2, "")
    prior = F.when(k % 4 == 0, " ACME ").when(k % 8 == 1, "Other").when(k % 4 == 2, "beta")
    rows = _orders(spark, sf_dir).select("o_orderkey", model.alias("model"), prior.alias("prior"))
    return replies.merge_values(rows).select("o_orderkey", "value", "outcome")


@_query("""with f as (select c_custkey, (c_custkey % 2 = 0)::int as a, (c_custkey % 3 = 0)::int as b, (c_custkey % 5 = 0)::int as o, (c_custkey % 7 = 0)::int as l from customer)
select c_custkey, (1 + a + b + o + l) || '/' || (4 + o) || ' (' || ((1 + a + b + o + l) * 100 // (4 + o)) || '%)' as completeness,
case when (1 + a + b + o + l) / (4 + o) >= 0.8 then 'Good' when (1 + a + b + o + l) / (4 + o) >= 0.5 then 'Partial' else 'Low' end as band from f""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = {"name": F.col("c_name"), "a": F.when(k % 2 == 0, "x").otherwise("null"), "b": F.when(k % 3 == 0, "x").otherwise(""), "o": F.when(k % 5 == 0, "x")}
    items = F.when(k % 7 == 0, F.array(F.lit("i"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", summaries.completeness(fields, {"o"}, {"items": items}).alias("c"))
    return rows.select("c_custkey", summaries.completeness_text(F.col("c")).alias("completeness"), F.col("c.band").alias("band"))


@_query("""select o_orderkey, case o_orderkey % 3 when 0 then 'T' || (o_orderkey % 9) when 1 then 'B' || (o_orderkey % 9) else '—' end as name,
case o_orderkey % 3 when 0 then '0.97' when 1 then '0.60' else '—' end as score from orders""")
def template_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    matched = F.concat(F.lit("Matched learned template `T"), _text(k % 9), F.lit("` with score 0.97."))
    best = F.concat(F.lit("Best learned template candidate was `B"), _text(k % 9), F.lit("` with similarity 0.6."))
    trace = F.when(k % 3 == 0, F.array(matched)).when(k % 3 == 1, F.array(best, F.lit("Applied learned template anchors."))).otherwise(F.array(best))
    rows = _orders(spark, sf_dir).select("o_orderkey", summaries.template_hit(trace).alias("t"))
    return rows.select("o_orderkey", "t.name", "t.score")


@_query("""select count(*) as total, count(*) filter (where o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0 and o_orderkey % 2 <> 0) as approved,
count(*) filter (where o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0 and o_orderkey % 2 = 0) as review, count(*) filter (where o_orderkey % 5 = 0 or o_orderkey % 3 = 0) as skipped_failed from orders""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return summaries.batch_counts(_orders(spark, sf_dir).select(summaries.batch_status(k % 5 == 0, k % 3 == 0, k % 2 == 0).alias("status")))


@_query("""select o_orderkey, 'N-' || o_orderkey as number, case when o_orderkey % 2 = 0 then 'Total ' || (o_orderkey % 10) end as whole from orders""")
def template_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of a template over texts: a named group, and a pattern without one."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("no: N-"), _text(k), F.when(k % 2 == 0, F.concat(F.lit("\nTotal "), _text(k % 10))).otherwise(""))
    anchors = F.create_map(F.lit("number"), F.lit(r"No\s*:\s*(?P<value>\S+)"), F.lit("whole"), F.lit(r"total \d"))
    rows = _orders(spark, sf_dir).select("o_orderkey", templates.anchor_values(anchors, text).alias("v"))
    return rows.select("o_orderkey", F.col("v")["number"].alias("number"), F.col("v")["whole"].alias("whole"))


_LINES = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@_query(rf"""with l as (select doc_id, {_LINES} as ls from documents)
select doc_id, sha256(array_to_string(list_transform(ls[1:8], lambda x: trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '#', 'g'), '\s+', ' ', 'g'))), ' | ')) as top_sha,
array_to_string(list_filter(['due date', 'invoice', 'supplier', 'tax', 'total', 'vendor'], lambda k: contains(lower(array_to_string(ls[1:20], ' ')), k)), ',') as keywords from l""")
def text_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", templates.text_signature(F.col("text")).alias("s"))
    return rows.select("doc_id", F.sha2(F.array_join("s.top_lines", " | "), 256).alias("top_sha"), F.array_join("s.keywords", ",").alias("keywords"))
