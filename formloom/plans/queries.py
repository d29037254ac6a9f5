"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, first_match, sections, upload_name
from ..operators import catalog, classify, dedup, dispatch, extract, metrics, quality_scores, spatial, templates, validate
from .render import discharges, invoices, ndas, table

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_HASH = r"sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')))"


@_query(f"select doc_id, {_HASH} as content_hash, doc_id <> min(doc_id) over (partition by {_HASH}) as is_duplicate from documents")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_each_hash(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "content_hash", "is_duplicate")


def _type_sql(source: str) -> str:
    score = lambda k: " + ".join(f"contains(lower(text), '{w}')::int" for w in classify.KEYWORDS[k])
    kinds = list(classify.KEYWORDS)
    scores = ", ".join(f"{score(k)} as s{i}" for i, k in enumerate(kinds))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(kinds))) + ")"
    case = " ".join(f"when s{i} = {best} then '{k}'" for i, k in enumerate(kinds))
    return f"with s as (select *, {scores} from {source}) select *, case when {best} = 0 then 'invoice' {case} end as document_type from s"


@_query(f"select doc_id, document_type from ({_type_sql('documents')})")
def detect_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.with_document_type(table(spark, sf_dir, "documents")).select("doc_id", "document_type")


@_query(f"select document_type, count(*) as n_docs, count(distinct {_HASH}) as n_distinct from ({_type_sql('documents')}) group by 1")
def doc_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "documents").select(classify.document_type(F.col("text")).alias("document_type"), content_hash(F.col("text")).alias("h"))
    per_text = typed.groupBy("document_type", "h").agg(F.count("*").alias("n"))
    return per_text.groupBy("document_type").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_distinct"))


@_query(r"""with s as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from documents)
select doc_id, cast(len(ls) as integer) as section_count, ls[1] as first_section from s""")
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", sections(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("section_count"), F.get("s", F.lit(0)).alias("first_section"))


@_query("select doc_id, 'doc-' || doc_id || '_' || sha256(coalesce(text, ''))[1:8] || '.txt' as upload_name from documents")
def upload_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", upload_name(name, F.coalesce("text", F.lit("")).cast("binary")).alias("upload_name"))


_INV = """with l as (select l_orderkey, round(sum(l_extendedprice), 2) as subtotal, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1),
i as (select o_orderkey, o_orderkey % 7 = 0 as bare, o_orderkey, c_name, o_orderdate, subtotal, n, round(subtotal * 0.08, 2) as tax from orders join customer on o_custkey = c_custkey join l on o_orderkey = l_orderkey),
v as (select o_orderkey, 'Supplier ' || (o_orderkey % 97) || case when bare then ' Ltd' else '' end as vendor_name, case when o_orderkey % 11 <> 0 then 'INV-' || o_orderkey end as invoice_number,
case when o_orderkey % 13 = 0 then '2024-99-01' else strftime(o_orderdate, '%Y-%m-%d') end as invoice_date, c_name as bill_to, 'Net 30' as payment_terms, subtotal, tax, round(subtotal + tax + case when o_orderkey % 5 = 0 then 1.0 else 0.0 end, 2) as total_amount, 'USD' as currency, n from i)
"""


@_query(_INV + "select o_orderkey, vendor_name, invoice_number, invoice_date, bill_to, payment_terms, subtotal, tax, total_amount, currency from v")
def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_invoices(invoices(spark, sf_dir)).select(
        "o_orderkey", "vendor_name", "invoice_number", "invoice_date", "bill_to", "payment_terms", "subtotal", "tax", "total_amount", "currency"
    )


@_query("""select l_orderkey as o_orderkey, 'Part ' || l_partkey as description, cast(l_quantity as integer) as quantity, count(*) as n, round(sum(l_extendedprice), 2) as total
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2, 3""")
def invoice_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = invoices(spark, sf_dir).select("o_orderkey", F.explode(extract.line_items(F.col("text"))).alias("i"))
    return items.groupBy("o_orderkey", "i.description", "i.quantity").agg(F.count("*").alias("n"), F.round(F.sum("i.total"), 2).alias("total"))


@_query(_INV + "select o_orderkey, vendor_name from v where o_orderkey % 7 = 0")
def invoice_vendor_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    labelled = first_match(text, extract.PATTERNS["invoice"]["vendor_name"])
    rows = invoices(spark, sf_dir).filter(labelled.isNull())
    return rows.select("o_orderkey", extract.unlabelled_vendor(text).alias("vendor_name"))


@_query(_INV + """, c as (select *, case when invoice_number is null then 1 else 0 end + case when o_orderkey % 13 = 0 then 1 else 0 end + case when o_orderkey % 5 = 0 then 1 else 0 end as n_fail from v)
select o_orderkey, cast(11 - n_fail as integer) as n_pass, cast(1 as integer) as n_warn, cast(n_fail as integer) as n_fail, n_fail > 0 as needs_review from c""")
def validate_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.with_checks(extract.extract_invoices(invoices(spark, sf_dir)), "invoice")
    count = {s: validate.status_count(F.col("checks"), s) for s in ("pass", "warn", "fail")}
    errors, mode = F.array().cast("array<string>"), F.lit("rule-based")
    review = validate.needs_review(errors, F.col("checks"), mode, F.lit(False))
    return rows.select("o_orderkey", *[c.alias(f"n_{s}") for s, c in count.items()], review.alias("needs_review"))


_STATS = _INV + """, f as (select o_orderkey, 'invoice_number' as field_name, invoice_number is null as e from v union all select o_orderkey, 'vendor_name', false from v union all select o_orderkey, 'due_date', true from v
union all select o_orderkey, unnest(['po_number', 'shipping_handling']), true from v union all select o_orderkey, unnest(['bill_to', 'payment_terms', 'subtotal', 'tax', 'total_amount', 'currency', 'line_items', 'invoice_date']), false from v),
g as (select *, case when e then null when (o_orderkey + length(field_name)) % 3 = 0 then 'Template' when o_orderkey % 4 = 0 then 'Inferred' else 'Rule-based' end as src,
case when e then null when (o_orderkey + length(field_name)) % 3 = 0 then 0.82 when o_orderkey % 4 = 0 then 0.488 else 0.72 end::double as conf from f)
"""


@_query(_STATS + "select 'invoice' as document_type, field_name, count(*) as n, cast(sum(e::int) as bigint) as n_null, cast(round(sum(e::int) * 100.0 / count(*), 1) as double) as null_rate from g group by 2")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.null_rates(_stats(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the catalogued fields of rendered invoices, with three sources."""
    rows = extract.extract_invoices(invoices(spark, sf_dir))
    long = dispatch.long_fields(rows, "invoice", "o_orderkey")
    key = F.col("o_orderkey")
    template, inferred = (key + F.length("field")) % 3 == 0, key % 4 == 0
    values = long.select(
        key.cast("string").alias("source_file"), "document_type", "field", "value", F.when(template, "Template").when(inferred, "Inferred").otherwise("Rule-based").alias("source"),
        F.when(template, 0.82).when(inferred, 0.488).otherwise(0.72).alias("confidence"),
    )
    return metrics.field_stats_long(values, catalog.FIELDS)


@_query(_STATS + """, c as (select field_name, src, count(*) as n from g where src is not null group by 1, 2)
select 'invoice' as document_type, field_name, arg_max(src, struct_pack(n := n, o := -ascii(src))) as top_source, string_agg(src || ' (' || n || ')', ', ' order by n desc, src) as breakdown from c group by 2""")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_breakdown(_stats(spark, sf_dir))


@_query(_STATS + "select 'invoice' as document_type, field_name, round(avg(conf), 3) as avg_conf, min(conf) as min_conf, max(conf) as max_conf from g where conf is not null group by 2")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confidence_stats(_stats(spark, sf_dir))


@_query(_STATS + """, names as (select unnest(['vendor_name', 'invoice_number', 'invoice_date', 'due_date', 'bill_to', 'po_number', 'payment_terms', 'subtotal', 'tax', 'shipping_handling', 'total_amount', 'currency', 'line_items']) as field_name, unnest(range(13)) as ord),
c as (select field_name, src, count(*) as n from g where src is not null group by 1, 2), m as (select field_name, string_agg(src || ' (' || n || ')', ', ' order by n desc, src) as method from c group by 1)
select cast(ord as integer) as ord, names.field_name, cast(round(sum(e::int) * 100.0 / count(*), 1) as double) as null_rate, coalesce(any_value(method), '—') as method, round(avg(conf), 3) as avg_conf
from names join g using (field_name) left join m using (field_name) group by 1, 2""")
def field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.field_table(_stats(spark, sf_dir), "invoice", catalog.FIELDS["invoice"])


@_query("""select c_custkey, c_name as disclosing_party, case when c_custkey % 5 <> 0 then 'Partner ' || c_custkey end as receiving_party, n_name as governing_law,
(c_custkey % 9 + 1) || ' years' as confidentiality_period, case c_custkey % 3 when 0 then 'mutual' when 1 then 'one-way' end as agreement_type from customer join nation on c_nationkey = n_nationkey""")
def nda_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extract_fields(ndas(spark, sf_dir), "nda").withColumn("agreement_type", extract.agreement_type(F.col("text")))
    return rows.select("c_custkey", "disclosing_party", "receiving_party", "governing_law", "confidentiality_period", "agreement_type")


@_query("""select cast(sum(case when c_custkey % 5 = 0 then 1 else 0 end) + 2 * count(*) as bigint) as n_fail, cast(sum(case when c_custkey % 3 = 2 then 1 else 0 end) as bigint) as no_type from customer join nation on c_nationkey = n_nationkey""")
def validate_nda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing checks: blank receivers, and both dates of every text, whose pattern stops at the year of an ISO date."""
    rows = extract.extract_fields(ndas(spark, sf_dir), "nda").withColumn("agreement_type", extract.agreement_type(F.col("text")))
    checks = validate.with_checks(rows, "nda").select(F.explode("checks").alias("c"))
    hit = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    return checks.agg(
        hit(F.col("c.status") == "fail", "n_fail"), hit((F.col("c.field") == "agreement_type") & (F.col("c.status") == "warn"), "no_type")
    )


@_query("""select o_orderkey, 'Clinic ' || (o_orderkey % 17) as facility_name, 'Code ' || (o_orderkey % 31) as primary_diagnosis, strftime(o_orderdate, '%Y-%m-%d') as admission_date,
cast(case when o_orderkey % 4 <> 0 then 2 else 0 end as integer) as n_medications, cast(case when o_orderkey % 6 = 0 then 1 else 0 end as integer) as n_fail from orders join customer on o_custkey = c_custkey""")
def medical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extract_fields(discharges(spark, sf_dir), "medical_discharge").withColumn("medications", extract.medications(F.col("text")))
    rows = validate.with_checks(rows, "medical_discharge")
    return rows.select(
        "o_orderkey", "facility_name", "primary_diagnosis", "admission_date",
        F.size("medications").alias("n_medications"), validate.status_count(F.col("checks"), "fail").alias("n_fail"),
    )


_TRACES = """with t as (select 'u' || user_id as source_file, case event_type when 'view' then 'Matched learned template x' when 'click' then 'Used OpenAI model' when 'error' then 'Applied human-reviewed corrections' else 'Parsed' end as message, ts from events)
"""


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    message = F.when(kind == "view", "Matched learned template x").when(kind == "click", "Used OpenAI model").when(kind == "error", "Applied human-reviewed corrections").otherwise("Parsed")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_file"), message.alias("message"), "ts")


@_query(_TRACES + """select (select count(distinct source_file) from t) as total_documents, count(distinct case when message like 'Matched%' then source_file end) as template_passed,
count(distinct case when message like 'Used%' then source_file end) as llm_fallback, count(distinct case when message like 'Applied%' then source_file end) as manual_corrections from t""")
def metrics_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traces(spark, sf_dir)
    return metrics.kpis(t.select("source_file").distinct(), t)


@_query(_TRACES + """, d as (select unnest(generate_series(date '2024-01-01', date '2024-02-04', interval 1 day))::date as date)
select d.date, count(distinct source_file) as llm_documents from d left join t on t.ts::date = d.date and message like 'Used%' group by 1""")
def llm_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _traces(spark, sf_dir).filter(metrics.any_of(F.col("message"), metrics.LLM_PHRASES))
    return metrics.daily_documents(used, "2024-02-04", 35, "ts", "source_file")


@_query("select event_id, ts as logged_at, props from events where event_type = 'error' order by ts desc, event_id desc limit 200")
def error_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", F.col("ts").alias("logged_at"), "props")


@_query("""with r as (select *, row_number() over (partition by label order by vec_id) as r from embeddings), t as (select label, vec_id, embedding from r where r <= 20),
c as (select vec_id, label, list_transform(range(1, 65), lambda i: case when i > 64 - 8 * (vec_id % 8) then 0.0 else embedding[i]::double end) as v from embeddings),
s as (select c.vec_id, c.label, t.vec_id as ord, round(coalesce(list_dot_product(c.v, t.embedding::double[]) / nullif(sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(t.embedding::double[], t.embedding::double[])), 0), 0), 4) as score from c join t using (label))
select vec_id, ord, score >= 0.55 as adaptive_hit, score >= 0.68 as llm_hit, score >= 0.85 as merge_hit from (select *, row_number() over (partition by vec_id order by score desc, ord) as k from s) where k = 1""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings against a full store: the first ``CAP`` rows of each label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("document_type"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    place = F.row_number().over(Window.partitionBy("document_type").orderBy("ord"))
    store = rows.withColumn("place", place).filter(F.col("place") <= templates.CAP).drop("place")
    docs = rows.select("document_type", F.col("ord").alias("vec_id"), F.transform("vector", lambda x, i: F.when(i >= 64 - 8 * (F.col("ord") % 8), 0.0).otherwise(x.cast("double"))).alias("vector"))
    best = templates.best_template(docs, store, "vec_id")
    return best.select("vec_id", "ord", *[(F.col("score") >= c).alias(n) for c, n in ((0.55, "adaptive_hit"), (0.68, "llm_hit"), (0.85, "merge_hit"))])


@_query("""with s as (select case when s_suppkey % 10 = 0 then 'template-' || s_suppkey else 'k' || s_suppkey end as n, s_acctbal as v, s_suppkey as o from supplier),
t as (select case when c_custkey % 7 = 0 then 'template-' || c_custkey else 'k' || c_custkey end as n, c_acctbal as v, c_custkey as o from customer)
select coalesce(s.n, t.n) as template_name, coalesce(s.v, t.v) as value, coalesce(t.o, s.o + 1099511627776) as ord from s full join t on s.n = t.n""")
def promote_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(t: str, k: str, v: str, blank: int) -> DataFrame:
        name = F.when(F.col(k) % blank != 0, F.concat(F.lit("k"), F.col(k).cast("string")))
        return table(spark, sf_dir, t).select(name.alias("template_name"), F.col(v).alias("value"), F.col(k).alias("ord"))

    return templates.promote(named("supplier", "s_suppkey", "s_acctbal", 10), named("customer", "c_custkey", "c_acctbal", 7))


@_query("""select l_orderkey as doc, round(max(n) over (partition by l_orderkey) * 0 + n / max(n) over (partition by l_orderkey), 4) as density, cell from
(select l_orderkey, cast(least(7, floor(round(l_linenumber * 90 / 800.0, 4) * 8)) * 10 + least(9, floor(round((l_partkey % 50) * 13 / 600.0, 4) * 10)) as integer) as cell, sum(length('Part ' || l_partkey))::double as n from lineitem group by all)""")
def zone_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 50) * 13.0, F.col("l_linenumber") * 90.0
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page_number"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"), x.alias("x0"), (x + 40).alias("x1"), y.alias("top"), (y + 10).alias("bottom"),
    )
    cells = spatial.zone_density(words).select("doc", F.posexplode("zone_density").alias("cell", "density"))
    return cells.filter("density > 0").select("doc", "density", "cell")


@_query("select l_orderkey as doc, cast(count(distinct l_linenumber) as integer) as n_rows, cast(count(*) as integer) as n_words from lineitem group by 1")
def row_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("l_linenumber") * 20.0 + F.col("l_partkey") % 2
    word = F.struct(F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_partkey") % 50).cast("double").alias("x0"), top.alias("top"), (top + 10).alias("bottom"))
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(word).alias("words"))
    rows = pages.select("doc", "words", spatial.cluster_rows(F.col("words")).alias("rows"))
    return rows.select("doc", F.size("rows").alias("n_rows"), F.size(F.flatten("rows")).alias("n_words"))


@_query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'Inferred' when o_orderkey % 3 = 0 then 'Template' else 'Rule-based' end as source,
case o_orderkey % 4 when 0 then 0.0 else case when o_orderkey % 5 = 0 then [0.65, 0.488, 0.227][o_orderkey % 4] when o_orderkey % 3 = 0 then [0.82, 0.615, 0.287][o_orderkey % 4] else [0.72, 0.54, 0.252][o_orderkey % 4] end end::double as confidence,
case o_orderkey % 4 when 0 then 'not extracted' when 1 then case when o_orderkey % 5 = 0 then 'orange' when o_orderkey % 3 = 0 then 'orange' else 'orange' end when 2 then case when o_orderkey % 5 <> 0 and o_orderkey % 3 = 0 then 'orange' else 'red' end else 'red' end as badge from orders""")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 5 == 0, "Inferred").when(key % 3 == 0, "Template").otherwise("Rule-based").alias("source"),
        F.when(key % 4 == 1, F.array(F.lit("pass"))).when(key % 4 == 2, F.array(F.lit("pass"), F.lit("warn"))).otherwise(F.array(F.lit("warn"), F.lit("fail"))).alias("s"),
    )
    rows = rows.withColumn("confidence", quality_scores.field_confidence(F.col("source"), quality_scores.worst_status(F.col("s")), key % 4 == 0))
    return rows.select("o_orderkey", "source", "confidence", quality_scores.badge(F.col("confidence")).alias("badge"))


@_query("""select o_orderkey, cast(case o_orderkey % 5 when 0 then 60 when 1 then 2 + o_orderkey % 30 when 2 then 30 when 3 then 15 end as integer) as wait from orders""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    seconds = F.concat(F.lit("Please try again in "), (key % 30 + 1).cast("string"), F.lit(".5s"))
    message = F.when(key % 5 == 0, "try again in 9m44.879s").when(key % 5 == 1, seconds).when(key % 5 == 2, "Retry after 30 seconds").when(key % 5 == 3, "HTTP 429").otherwise("bad request")
    return table(spark, sf_dir, "orders").select("o_orderkey", quality_scores.retry_after(message).alias("wait"))


@_query("""with w as (select o_custkey, list(o_orderkey % 60 order by o_orderkey % 60) as ws from orders group by 1) select o_custkey, ws[len(ws) // 2 + 1] as median_wait from w""")
def median_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey") % 60).alias("w"))
    return waits.select("o_custkey", quality_scores.upper_median(F.col("w")).alias("median_wait"))


@_query("select o_orderkey, o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0 and (o_orderkey % 7 = 0 or o_orderkey % 2 = 0) as approved from orders")
def auto_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    errors = F.when(key % 3 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    conf = F.when(key % 7 == 0, F.array(F.lit(0.0))).when(key % 2 == 0, F.array(F.lit(0.0), F.lit(0.9))).otherwise(F.array(F.lit(0.5), F.lit(0.9)))
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", quality_scores.auto_approved(errors, F.when(key % 4 == 0, 1).otherwise(0), conf, True, 0.8).alias("approved"))


@_query("""select c_custkey, case when c_custkey % 3 = 0 then 'new' else c_name end as name, case when c_custkey % 3 = 0 then 1 end as version from customer""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    new = old.filter(F.col("c_custkey") % 3 == 0).select("c_custkey", F.lit("new").alias("name"), F.lit(1).alias("version"))
    return dedup.upsert(old, new, "c_custkey")


@_query("""with v as (select o_orderkey, case when o_orderkey % 3 <> 0 then 'acme  co' else '' end as a, case when o_orderkey % 2 = 0 then lower(o_orderpriority) else '' end as b, '' as c,
case o_orderkey % 5 when 0 then '' when 1 then (o_orderkey % 1000)::varchar || '.5' when 2 then (20000000 + o_orderkey % 1000)::varchar || '.0' when 3 then '0.00025' else '1234567.25' end as d from orders)
select o_orderkey, case when (a <> '')::int + (b <> '')::int + (d <> '')::int >= 2 then sha256(a || '|' || b || '|' || c || '|' || d) else '' end as fp from v""")
def semantic_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of invoices with two, three or fewer fields, amounts of many sizes, and white space inside a name."""
    key = F.col("o_orderkey")
    amount = F.when(key % 5 == 0, 0.0).when(key % 5 == 1, key % 1000 + 0.5).when(key % 5 == 2, (20000000 + key % 1000).cast("double")).when(key % 5 == 3, 0.00025).otherwise(1234567.25)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 3 != 0, " Acme  Co ").alias("vendor_name"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("invoice_number"), F.lit(" ").alias("invoice_date"),
        amount.cast("double").alias("total_amount"),
    )
    return rows.select("o_orderkey", dedup.document_fingerprint(rows, "invoice").alias("fp"))
