"""Registered queries over tables of types, logs, batches, forms and model replies, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, catalog, dedup, metrics, replies, summaries
from ..sinks import store
from ..sources import pdf, stores
from .queries import _query, _traces
from .render import table


def _text(n: Column) -> Column:
    return n.cast("string")


def _key() -> Column:
    return F.col("o_orderkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two types with lists, a raw name for some, and fields that their table does not select."""
    k = _key()
    return _orders(spark, sf_dir).select(
        F.concat(F.lit("f"), _text(k)).alias("source_file"), F.when(k % 2 == 0, F.concat(F.lit("up"), _text(k), F.lit(".txt"))).otherwise("").alias("original_filename"), F.lit("h").alias("content_hash"),
        F.when(k % 3 == 0, "nda").otherwise("invoice").alias("document_type"), F.concat(F.lit("V"), _text(k % 9)).alias("vendor_name"), F.col("o_totalprice").alias("total_amount"),
        F.when(k % 5 == 0, F.array().cast("array<struct<description:string,quantity:int>>")).otherwise(F.array(F.struct(F.lit("x").alias("description"), F.lit(1).alias("quantity")))).alias("line_items"),
        F.concat(F.lit("D"), _text(k % 4)).alias("disclosing_party"), F.lit("secret").alias("signatory_disclosing"),
    )


@_query("""select 'f' || o_orderkey as source_file, case when o_orderkey % 2 = 0 then 'up' || o_orderkey || '.txt' else 'f' || o_orderkey end as original_filename, '2024-02-03 04:05:06' as processed_at,
'V' || (o_orderkey % 9) as vendor_name, o_totalprice as total_amount, case when o_orderkey % 5 = 0 then '[]' else '[{"description":"x","quantity":1}]' end as line_items, null::varchar as due_date, 17 as n_columns from orders where o_orderkey % 3 <> 0""")
def type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices among the records, in the columns of their table."""
    rows = catalog.type_table(_records(spark, sf_dir), "invoice", now=F.lit("2024-02-03 04:05:06"))
    return rows.select("source_file", "original_filename", "processed_at", "vendor_name", "total_amount", "line_items", "due_date", F.lit(len(rows.columns)).alias("n_columns"))


@_query("""select 'f' || o_orderkey as source_file, 'D' || (o_orderkey % 4) as disclosing_party, 'secret' as signatory_disclosing, 8 as n_columns from orders where o_orderkey % 3 = 0""")
def selected_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements in a selection of fields that adds one and leaves out those that are not required."""
    selection = catalog.select_fields(catalog.default_selection(), "nda", ["signatory_disclosing"])
    rows = catalog.type_table(_records(spark, sf_dir), "nda", selection)
    return rows.select("source_file", "disclosing_party", "signatory_disclosing", F.lit(len(rows.columns)).alias("n_columns"))


def _type_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of three types from events; the other two are missing."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("u"), _text(F.col("user_id"))).alias("source_file"), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd HH:mm:ss").alias("processed_at"), "event_type")
    kinds = {"invoice": "view", "nda": "click", "lab_report": "error"}
    return {kind: rows.filter(F.col("event_type") == e).drop("event_type") for kind, e in kinds.items()}


@_query("""with n as (select case event_type when 'view' then 'invoice' when 'click' then 'nda' when 'error' then 'lab_report' end as k, count(*) as n from events group by 1)
select k.document_type, k."table", coalesce(n.n, 0) as records from (values ('invoice', 'invoices'), ('medical_discharge', 'discharge_summaries'), ('nda', 'ndas'), ('lab_report', 'lab_reports'), ('business_doc', 'business_docs')) k(document_type, "table") left join n on n.k = k.document_type""")
def records_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.records_by_type(_type_tables(spark, sf_dir), catalog.TABLES)


@_query("""with t as (select 'u' || user_id as source_file, event_type from events), k as (select count(distinct source_file) as total_documents, count(distinct case when event_type = 'view' then source_file end) as template_passed,
count(distinct case when event_type = 'click' then source_file end) as llm_fallback, count(distinct case when event_type = 'error' then source_file end) as manual_corrections, count(*) filter (where event_type in ('view', 'click', 'error')) as records_created from t)
select *, round(template_passed * 100.0 / total_documents, 1)::double as template_passed_pct, round(llm_fallback * 100.0 / total_documents, 1)::double as llm_fallback_pct, round(manual_corrections * 100.0 / total_documents, 1)::double as manual_corrections_pct from k""")
def kpi_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = _traces(spark, sf_dir)
    return metrics.kpi_bundle(traces.select("source_file").distinct(), traces, _type_tables(spark, sf_dir))


@_query("""with d as (select unnest(generate_series(date '2024-01-10', date '2024-02-04', interval 1 day))::date as date), u as (select distinct 'u' || user_id as s from events where event_type = 'click' and user_id % 2 = 0),
p as (select 'u' || user_id as s, ts::date + 1 as date from events where event_type in ('view', 'click', 'error'))
select d.date, count(distinct p.s) as llm_documents from d left join (select p.* from p join u using (s)) p on p.date = d.date group by 1""")
def model_use_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three tables whose traces name a model, by day; only even users ever used one."""
    traces = _traces(spark, sf_dir)
    traces = traces.withColumn("message", F.when(F.substring("source_file", 2, 20).cast("long") % 2 == 0, F.col("message")).otherwise("Parsed"))
    return metrics.model_use_daily(list(_type_tables(spark, sf_dir).values()), traces, "2024-02-04", 26)


@_query("""select 'u' || user_id as source_file, count(*) as n_steps, arg_min(case event_type when 'view' then 'Matched learned template x' when 'click' then 'Used OpenAI model' when 'error' then 'Applied human-reviewed corrections' else 'Parsed' end, event_id) as first_step from events group by 1""")
def traces_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each document, gathered and ordered, from the table of traces."""
    kind = F.col("event_type")
    message = F.when(kind == "view", "Matched learned template x").when(kind == "click", "Used OpenAI model").when(kind == "error", "Applied human-reviewed corrections").otherwise("Parsed")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), _text(F.col("user_id"))).alias("source_file"), F.col("event_id").alias("step_number"), message.alias("message"))
    return stores.traces_by_document(rows).select("source_file", F.size("trace").cast("long").alias("n_steps"), F.get("trace", F.lit(0)).alias("first_step"))


@_query("""select 'u' || user_id as source_file, event_type, count(*) as n from events where user_id in (select user_id from events where event_type = 'purchase') group by all""")
def documents_with_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("u"), _text(F.col("user_id"))).alias("source_file")
    documents = events.filter("event_type = 'purchase'").select(name).distinct()
    return metrics.documents_with_traces(documents, events.select(name, "event_type")).groupBy("source_file", "event_type").agg(F.count("*").alias("n"))


@_query("""select case event_type when 'error' then 'document' else 'system' end as kind, count(*) as n, min(event_id) as first from events where event_type in ('error', 'view', 'click') group by 1""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", "document_processing").when(kind == "view", "infrastructure").when(kind == "click", "code").otherwise("other").alias("error_type"))
    parts = store.document_errors(log).withColumn("kind", F.lit("document")).union(store.system_errors(log).withColumn("kind", F.lit("system")))
    return parts.groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@_query("select o_orderkey, o_orderdate as processed_at from orders order by o_orderdate desc, o_orderkey desc limit 200")
def upload_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_orders(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").alias("processed_at")), "processed_at", ["o_orderkey"])


@_query("""with f as (select o_orderkey, 'bytes ' || (o_orderkey % 97) as c from orders), g as (select *, min(o_orderkey) over (partition by c) as first from f)
select o_orderkey, sha256(c) as hash, case when o_orderkey <> first then 'duplicate of ''n' || first || ''' in this batch' end as skip_reason from g""")
def upload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("bytes "), _text(_key() % 97)).cast("binary")
    files = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("n"), _text(_key())).alias("name"), content.alias("content"))
    return dedup.first_upload(files, "o_orderkey").select("o_orderkey", "hash", "skip_reason")


@_query("""with f as (select o_orderkey, case when o_orderkey % 11 = 0 then '' else 'h' || (o_orderkey % 53) end as h, case when o_orderkey % 7 = 0 then 'failed' when o_orderkey % 5 = 0 then 'duplicate' else 'success' end as s from orders),
g as (select *, min(case when s = 'success' and h <> '' then o_orderkey end) over (partition by h) as first from f)
select o_orderkey, case when s = 'success' and h <> '' and o_orderkey <> first then 'duplicate' else s end as status, case when s = 'success' and h <> '' and o_orderkey <> first then 'Duplicate: same content as ''f' || first || ''' in this batch' else '' end as errors from g""")
def batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", F.concat(F.lit("f"), _text(k)).alias("source_file"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("h"), _text(k % 53))).alias("content_hash"),
        F.when(k % 7 == 0, "failed").when(k % 5 == 0, "duplicate").otherwise("success").alias("status"), F.lit("").alias("errors"),
    )
    return dedup.first_completed(rows, "o_orderkey").select("o_orderkey", "status", "errors")


@_query("""select 'f' || o_orderkey as source_file, case when o_orderkey % 2 = 0 then 'unknown' else 'invoice' end as document_type, true as duplicate, false as needs_review,
case when o_orderkey % 2 = 0 then 'Duplicate: identical document content was already processed.' else 'Duplicate: same document was already processed in a different format (e.g. scanned vs. text-based PDF).' end as errors
from orders where (o_orderkey % 2 = 0 and o_orderkey % 40 < 10) or (o_orderkey % 2 = 1 and o_orderkey % 40 between 1 and 5)""")
def stored_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the store holds by their content or, failing that, by their fields; empty keys match nothing."""
    k = _key()
    docs = _orders(spark, sf_dir).select(
        F.concat(F.lit("f"), _text(k)).alias("source_file"), F.lit("invoice").alias("document_type"), F.when(k % 2 == 0, F.concat(F.lit("h"), _text(k % 40))).otherwise("").alias("content_hash"),
        F.when(k % 2 == 1, F.concat(F.lit("p"), _text(k % 40))).otherwise("").alias("semantic_fingerprint"),
    )
    known = spark.range(10).select(F.concat(F.lit("h"), _text(F.col("id"))).alias("content_hash"), F.when(F.col("id").between(1, 5), F.concat(F.lit("p"), _text(F.col("id")))).otherwise("").alias("semantic_fingerprint"))
    known = known.union(spark.createDataFrame([("", "")], "a string, b string"))
    by_content = dedup.duplicate_rows(docs, known, "content_hash")
    by_fields = dedup.duplicate_rows(dedup.not_seen(docs, known, "content_hash"), known, "semantic_fingerprint")
    return by_content.union(by_fields).select("source_file", "document_type", "duplicate", "needs_review", F.get("errors", F.lit(0)).alias("errors"))


@_query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'failed' when o_orderkey % 7 = 0 then 'duplicate' when o_orderkey % 2 = 0 then 'auto-approved' else 'needs review' end as status_label,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then case when o_orderkey % 3 = 0 then 'template' else '—' end end as extraction_mode,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then case when o_orderkey % 3 = 0 then 'T' else '—' end end as template, case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then case when o_orderkey % 3 = 0 then '0.91' else '—' end end as score,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then case when o_orderkey % 3 = 1 then 'Yes' else 'No' end end as model_used, case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then case when o_orderkey % 4 = 0 then '—' else (o_orderkey % 9)::varchar || '.5' end end as seconds,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then case when o_orderkey % 2 = 0 then '2/2 (100%)' else '1/2 (50%)' end end as completeness, case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then 1 + (o_orderkey % 2 = 0)::int end::integer as n_pass,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then (o_orderkey % 2 = 1)::int end::integer as n_fail, case when o_orderkey % 5 = 0 then 'a; b' else '' end as errors from orders""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    check = lambda s: F.struct(F.lit("f").alias("field"), s.alias("status"), F.lit("").alias("message"))
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", F.concat(F.lit("f"), _text(k)).alias("source_file"), F.when(k % 5 == 0, "failed").when(k % 7 == 0, "duplicate").when(k % 2 == 0, "auto-approved").otherwise("needs review").alias("status_label"),
        F.when(k % 3 == 0, "template").alias("extraction_mode"), F.when(k % 3 == 0, F.array(F.lit("Matched learned template `T` with score 0.91."))).when(k % 3 == 1, F.array(F.lit("Used Gemini for this."))).otherwise(F.array(F.lit("x"))).alias("trace"),
        F.array(check(F.lit("pass")), check(F.when(k % 2 == 0, "pass").otherwise("fail"))).alias("checks"), F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.lit("h").alias("content_hash"), F.when(k % 4 != 0, k % 9 + 0.5).cast("double").alias("seconds"), F.lit("v").alias("a"), F.when(k % 2 == 0, "w").alias("b"),
    )
    done = summaries.completeness_text(summaries.completeness({"a": F.col("a"), "b": F.col("b")}, set()))
    out = batch.summary_rows(rows, done)
    return out.select(F.substring("source_file", 2, 20).cast("long").alias("o_orderkey"), "status_label", "extraction_mode", "template", "score", "model_used", "seconds", "completeness", "n_pass", "n_fail", "errors")


@_query("""select o_custkey, case when n = 0 then '—' else printf('%.1f%%', c * 100.0 / n) end as review_rate from (select c_custkey as o_custkey, count(o_orderkey) as n, count(*) filter (where o_orderkey % 4 = 0) as c from customer left join orders on o_custkey = c_custkey group by 1)""")
def review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer, also where a customer's row repeats."""
    orders = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg(F.count("o_orderkey").alias("documents"), F.count_if(_key() % 4 == 0).alias("corrections"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").distinct().join(orders, F.col("c_custkey") == F.col("k"), "left").na.fill(0, ["documents", "corrections"])
    return rows.select(F.col("c_custkey").alias("o_custkey"), batch.review_rate(rows).alias("review_rate"))


@_query("""select 'approved' as part, count(*) as n, sum(o_orderkey)::bigint as keys from orders where o_orderkey % 5 > 1 and o_orderkey % 3 = 0
union all select 'flagged', count(*), sum(o_orderkey)::bigint from orders where o_orderkey % 5 > 1 and o_orderkey % 3 <> 0""")
def batch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", F.when(_key() % 5 == 0, "failed").when(_key() % 5 == 1, "duplicate").otherwise("success").alias("status"), F.when(_key() % 3 == 0, True).when(_key() % 3 == 1, False).alias("ok"))
    parts = batch.route(rows, F.col("ok"))
    return parts[0].withColumn("part", F.lit("approved")).union(parts[1].withColumn("part", F.lit("flagged"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@_query("""select o_orderkey, case when o_orderkey % 3 = 0 then null else 1234.5 end::double as total_amount, case o_orderkey % 3 when 1 then '$1,234.50' when 2 then '1234.5' end as total_amount_raw, case when o_orderkey % 2 = 0 then 'Acme' end as vendor_name,
case when o_orderkey % 5 = 0 then 'nda' else 'invoice' end as document_type, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 'EUR' else 'USD' end as currency,
cast(case o_orderkey % 4 when 0 then 2 when 1 then 0 when 2 then 0 else 0 end as integer) as n_items from orders""")
def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    form = _orders(spark, sf_dir).select(
        "o_orderkey", F.when(k % 3 == 0, "  ").when(k % 3 == 1, " $1,234.50").otherwise("1234.5").alias("total_amount"), F.when(k % 2 == 0, " Acme ").otherwise("").alias("vendor_name"),
        F.when(k % 5 == 0, "nda").otherwise(" ").alias("document_type"), F.when((k % 7 == 0) & (k % 5 != 0), "EUR").otherwise("").alias("currency"),
        F.when(k % 4 == 0, '[{"description": "a"}, {"description": "b"}]').when(k % 4 == 1, '{"description": "a"}').when(k % 4 == 2, "none").otherwise("").alias("line_items"),
    )
    rows = batch.form_values(form, ["total_amount", "vendor_name", "document_type", "currency"])
    items = batch.line_items_of(F.col("line_items"), "array<struct<description:string>>")
    return rows.select("o_orderkey", "total_amount", "total_amount_raw", "vendor_name", "document_type", "currency", F.size(items).alias("n_items"))


@_query("""select o_orderkey, 'invoice' as document_type, case o_orderkey % 4 when 0 then 'Acme' when 1 then 'Beta' end as vendor_name, case o_orderkey % 4 when 0 then 1200.5 when 1 then null end::double as total_amount,
case when o_orderkey % 4 = 1 then 'EUR' else 'USD' end as currency, cast(case when o_orderkey % 4 = 0 then 1 else 0 end as integer) as n_items, case when o_orderkey % 4 = 3 then 'Error code: 429' when o_orderkey % 4 = 2 then 'The LLM returned an empty response.' end as failure,
cast(case when o_orderkey % 4 = 3 then 15 end as integer) as wait from orders""")
def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked of a client that answers, answers oddly, says nothing, or refuses."""
    from ..operators.quality_scores import retry_after

    def client(request: dict) -> str:
        kind = int(request["messages"][1]["content"].rsplit("\n", 1)[1]) % 4
        if kind == 3:
            raise RuntimeError("Error code: 429")
        return ('```json\n{"vendor_name": "Acme", "total_amount": "$1,200.50", "line_items": [{"description": "x"}], "other": 1}\n```', 'Sure: {"vendor_name": "Beta", "currency": "EUR", "line_items": "none"} Done.', "")[kind]

    docs = _orders(spark, sf_dir).select("o_orderkey", F.lit("invoice").alias("document_type"), _text(_key()).alias("text"))
    asked = replies.ask_by_type(docs, client, "any", "ollama")
    record = replies.reply_record(F.col("reply"), "invoice")
    rows = asked.select("o_orderkey", "failure", *[record[c].alias(c) for c in ("document_type", "vendor_name", "total_amount", "currency", "line_items")])
    return rows.select("o_orderkey", "document_type", "vendor_name", "total_amount", "currency", F.size("line_items").alias("n_items"), "failure", retry_after(F.col("failure")).alias("wait"))


@_query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'Cross-validated — multiple methods agree on: a.' when o_orderkey % 3 = 1 then 'LLM value differs from prior extraction (LLM used): a.' end as first_step,
'Restored prior extraction values where LLM returned null: b, c.' as last_step, cast(case when o_orderkey % 3 = 2 then 1 else 2 end as integer) as n_steps from orders""")
def merge_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda f, m, p: F.struct(F.lit(f).alias("field"), m.alias("model"), p.alias("prior"))
    none = F.lit(None).cast("string")
    a = pair("a", F.when(_key() % 3 == 0, " X").when(_key() % 3 == 1, "y").otherwise("z"), F.when(_key() % 3 < 2, "x"))
    rows = _orders(spark, sf_dir).select("o_orderkey", F.inline(F.array(a, pair("c", none, F.lit("p")), pair("b", F.lit(""), F.lit("q")), pair("d", none, none))))
    steps = replies.merge_steps(replies.merge_values(rows), "o_orderkey")
    first = F.when(F.size("trace") > 1, F.get("trace", F.lit(0)))
    return steps.select("o_orderkey", first.alias("first_step"), F.element_at("trace", -1).alias("last_step"), F.size("trace").alias("n_steps"))


@_query("""select l_orderkey as doc, l_linenumber, 'w' || l_partkey as text, (l_linenumber * 30)::double as x0, (l_linenumber * 30 + l_quantity)::double as x1, (l_linenumber * 50)::double as top, (l_linenumber * 50 + 5)::double as bottom
from lineitem where l_partkey % 100 >= 30 and l_partkey % 7 <> 0""")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page drawn at twice its size; blank words, and those of little or no confidence, go."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    boxes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), "l_linenumber", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.lit(1200).alias("image_width"), F.lit(1600).alias("image_height"),
        F.when(p % 7 == 0, "  ").otherwise(F.concat(F.lit(" w"), _text(p))).alias("text"), F.when(p % 100 < 30, F.when(p % 2 == 0, _text(p % 100)).otherwise("none")).otherwise(_text(p % 100)).alias("conf"),
        (n * 60).alias("left"), (n * 100).alias("top"), (F.col("l_quantity") * 2).alias("width"), F.lit(10).alias("height"),
    )
    return pdf.recognised_words(boxes, ["doc", "l_linenumber"]).select("doc", "l_linenumber", "text", "x0", "x1", "top", "bottom")
