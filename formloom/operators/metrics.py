"""Metrics over traces and field statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trace phrases.
LLM_PHRASES = ("llm reasoning layer", "used openai", "used groq", "used openrouter", "used ollama", "used gemini")
TEMPLATE_VERBS = ("matched", "applied", "used")
MANUAL_PHRASES = ("human-reviewed corrections",)


def any_of(text: Column, phrases) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def kpis(documents: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: documents, and documents with template hits, model use and manual corrections."""
    template = F.contains(F.lower("message"), F.lit("learned template")) & any_of(F.col("message"), TEMPLATE_VERBS)
    distinct = lambda cond, name: F.count_distinct(F.when(cond, F.col("source_file"))).alias(name)
    used = traces.agg(
        distinct(template, "template_passed"),
        distinct(any_of(F.col("message"), LLM_PHRASES), "llm_fallback"),
        distinct(any_of(F.col("message"), MANUAL_PHRASES), "manual_corrections"),
    )
    total = documents.agg(F.count("*").alias("total_documents"))
    names = ["total_documents", *used.columns]
    return total.unionByName(used, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def daily_documents(rows: DataFrame, as_of: str, days: int, ts: str, key: str) -> DataFrame:
    """Distinct keys a day for the ``days`` up to ``as_of``, zero where there are none."""
    if days <= 0:
        raise ValueError("days must be positive")
    spark = rows.sparkSession
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    calendar = spark.range(1).select(F.explode(F.sequence(first, F.lit(as_of).cast("date"))).alias("date"))
    counts = rows.filter(F.to_date(ts).between(first, F.lit(as_of).cast("date"))).groupBy(F.to_date(ts).alias("date")).agg(
        F.count_distinct(key).alias("llm_documents")
    )
    return calendar.join(counts, "date", "left").select("date", F.coalesce("llm_documents", F.lit(0)).alias("llm_documents"))


def null_rates(stats: DataFrame) -> DataFrame:
    return stats.groupBy("document_type", "field_name").agg(
        F.count("*").alias("n"), F.sum("is_null").alias("n_null"),
        F.round(F.sum("is_null") * 100.0 / F.count("*"), 1).cast("double").alias("null_rate"),
    )


def source_breakdown(stats: DataFrame) -> DataFrame:
    """Sources of each field by count, ties by name, and the most frequent one."""
    counts = stats.filter("extraction_source is not null").groupBy("document_type", "field_name", "extraction_source").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "extraction_source", "n")))
    line = F.array_join(F.transform("r", lambda x: F.concat(x["extraction_source"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    return counts.groupBy("document_type", "field_name").agg(ranked.alias("r")).select(
        "document_type", "field_name", F.get("r", F.lit(0))["extraction_source"].alias("top_source"), line.alias("breakdown")
    )


def confidence_stats(stats: DataFrame) -> DataFrame:
    rows = stats.filter("confidence is not null")
    return rows.groupBy("document_type", "field_name").agg(
        *[F.round(f("confidence"), 3).alias(n) for f, n in ((F.avg, "avg_conf"), (F.min, "min_conf"), (F.max, "max_conf"))]
    )


def field_stats(rows: DataFrame, document_type: str, fields: list[str], source: str, confidence: float) -> DataFrame:
    """One row for each catalogued field of a document: null flag, and source and confidence where present."""
    struct = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("v"))
    long = rows.select("source_file", F.explode(F.array(*[struct(f) for f in fields])).alias("s"))
    empty = F.col("s.v").isNull() | F.col("s.v").isin("", "[]")
    return long.select(
        "source_file", F.lit(document_type).alias("document_type"), "s.field_name", empty.cast("int").alias("is_null"),
        F.when(~empty, source).alias("extraction_source"), F.when(~empty, confidence).alias("confidence"),
    )


def records_by_type(tables: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """document_type, table, records: a row for each type of ``names``, 0 where a table is missing."""
    spark = next(iter(tables.values())).sparkSession
    kinds = spark.createDataFrame(list(names.items()), "document_type string, table string")  # one row for each type
    counts = [t.agg(F.count("*").alias("records")).select(F.lit(kind).alias("document_type"), "records") for kind, t in tables.items()]
    return kinds.join(reduce(DataFrame.union, counts), "document_type", "left").select("document_type", "table", F.coalesce("records", F.lit(0)).alias("records"))


def records_created(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: rows of all tables of types."""
    counts = [t.agg(F.count("*").alias("n")) for t in tables.values()]
    return reduce(DataFrame.union, counts).agg(F.sum("n").alias("records_created"))


def kpi_bundle(documents: DataFrame, traces: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: documents, template hits, model use, manual corrections and records, each also as a share of documents."""
    parts = [documents.agg(F.count("*").alias("n")).select(F.lit("total_documents").alias("k"), "n")]
    template = F.contains(F.lower("message"), F.lit("learned template")) & any_of(F.col("message"), TEMPLATE_VERBS)
    tests = {"template_passed": template, "llm_fallback": any_of(F.col("message"), LLM_PHRASES), "manual_corrections": any_of(F.col("message"), MANUAL_PHRASES)}
    used = traces.agg(*[F.count_distinct(F.when(c, F.col("source_file"))).alias(k) for k, c in tests.items()])
    parts.append(used.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in tests]))))
    parts.append(records_created(tables).select(F.lit("records_created"), F.coalesce("records_created", F.lit(0))))
    names = ["total_documents", *tests, "records_created"]
    row = reduce(DataFrame.union, parts).agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in names])
    share = lambda k: F.when(F.col("total_documents") > 0, F.round(F.col(k) * 100.0 / F.col("total_documents"), 1).cast("double"))
    return row.select("*", *[share(k).alias(f"{k}_pct") for k in tests])


def model_use_daily(tables: list[DataFrame], traces: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """date, llm_documents: distinct documents of any table whose trace names a model, by day of processing; zero where there are none."""
    documents = reduce(DataFrame.union, [t.select("source_file", "processed_at") for t in tables])
    used = traces.filter(any_of(F.col("message"), LLM_PHRASES)).select("source_file").distinct()
    return daily_documents(documents.join(used, "source_file", "left_semi"), as_of, days, "processed_at", "source_file")


def documents_with_traces(documents: DataFrame, traces: DataFrame) -> DataFrame:
    return documents.join(traces, "source_file")


def types_with_stats(stats: DataFrame) -> DataFrame:
    return stats.select("document_type").distinct().orderBy("document_type")


def field_stats_long(values: DataFrame, catalogue: dict[str, list[str]]) -> DataFrame:
    """A row for each catalogued field of a document's type, from long ``values(source_file, document_type, field, value, source, confidence)``.

    A field is null without a value; its source and confidence are then null too.
    """
    spark = values.sparkSession
    fields = spark.createDataFrame([(k, f) for k, fs in catalogue.items() for f in fs], "document_type string, field_name string")  # the catalogue, 73 rows
    documents = values.select("source_file", "document_type").distinct()
    given = values.withColumnRenamed("field", "field_name")
    rows = documents.join(F.broadcast(fields), "document_type").join(given, ["source_file", "document_type", "field_name"], "left")
    empty = F.col("value").isNull() | F.col("value").isin("", "[]")
    return rows.select(
        "source_file", "document_type", "field_name", empty.cast("int").alias("is_null"),
        F.when(~empty, F.col("source")).alias("extraction_source"), F.when(~empty, F.col("confidence")).alias("confidence"),
    )


def field_table(stats: DataFrame, document_type: str, fields: list[str]) -> DataFrame:
    """ord, field_name, null_rate, method, avg_conf: the catalogued fields of a type in order, whatever is known of each."""
    spark = stats.sparkSession
    listed = spark.createDataFrame(list(enumerate(fields)), "ord int, field_name string")
    mine = stats.filter(F.col("document_type") == document_type)
    by_field = lambda df, *columns: df.select("field_name", *columns)
    return (
        listed.join(by_field(null_rates(mine), "null_rate"), "field_name", "left")
        .join(by_field(source_breakdown(mine), F.col("breakdown").alias("method")), "field_name", "left")
        .join(by_field(confidence_stats(mine), "avg_conf"), "field_name", "left")
        .select("ord", "field_name", "null_rate", F.coalesce("method", F.lit("—")).alias("method"), "avg_conf")
    )
