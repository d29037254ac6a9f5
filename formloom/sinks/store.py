"""Sinks of processed documents: files for each of them, tables, logs, exports, and their reset."""

from __future__ import annotations

import json
import logging
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog
from .writers import encode_nested

UPLOADS = "original_filename string, upload_path string, file_size_bytes bigint, processed_at string"
ERRORS = "error_type string, source string, severity string, message string, logged_at string"
FIELD_STATS = "source_file string, document_type string, field_name string, is_null int, extraction_source string, confidence double"
CHECKS = "source_file string, field string, status string, message string"
TRACES = "source_file string, step_number int, message string"
#: What an output choice writes.
FORMS = {"JSON": ("json",), "CSV": ("csv",), "Both": ("json", "csv")}


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def schemas() -> dict[str, T.StructType]:
    """Every table of the store with its columns."""
    simple = {"pdf_uploads": UPLOADS, "error_log": ERRORS, "field_stats": FIELD_STATS, "validation_results": CHECKS, "extraction_traces": TRACES}
    out = {name: T.StructType.fromDDL(columns) for name, columns in simple.items()}
    return out | {"document_results": catalog.results_schema()} | {t: catalog.table_schema(kind) for kind, t in catalog.TABLES.items()}


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Empty tables for those that a store lacks."""
    for name, schema in schemas().items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def pretty_json(value: Column) -> Column:
    """JSON text with an indent of two."""

    @F.pandas_udf("string")
    def dump(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2))

    return dump(value)


def python_text(value: Column) -> Column:
    """JSON text as Python writes its value, as lists are in a CSV file."""

    @F.pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repr(json.loads(t)))

    return write(value)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def write_json_files(records: DataFrame, path: str, name: str = "source_file", mode: str = "append") -> None:
    """One indented JSON document for each record, in a folder ``stem=…`` of its own."""
    body = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    records.select(_stem(F.col(name)).alias("stem"), pretty_json(body).alias("value")).write.mode(mode).partitionBy("stem").option("lineSep", "\n").text(path)


def write_trace_files(records: DataFrame, path: str, name: str = "source_file", trace: str = "trace", mode: str = "append") -> None:
    """One JSON document ``{"trace": [...]}`` for each record."""
    body = F.to_json(F.struct(F.col(trace).alias("trace")))
    records.select(_stem(F.col(name)).alias("stem"), pretty_json(body).alias("value")).write.mode(mode).partitionBy("stem").text(path)


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as CSV with a header; lists and structs as Python writes them."""
    nested = {f.name for f in records.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    encoded = encode_nested(records)
    encoded.select(*[python_text(F.col(c)).alias(c) if c in nested else F.col(c) for c in encoded.columns]).write.mode(mode).csv(path, header=True, escape='"')


def export(records: DataFrame, path: str, choice: str = "Both", mode: str = "errorifexists") -> list[str]:
    """Writes the forms of an output choice and returns their folders."""
    out = []
    for form in FORMS[choice]:
        target = f"{path}/{form}"
        write_csv(records, target, mode) if form == "csv" else write_json_files(records, target, mode=mode)
        out.append(target)
    return out


def export_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A summary or a log as CSV with a header."""
    encode_nested(table).write.mode(mode).csv(path, header=True)


def checks_table(results: DataFrame) -> DataFrame:
    return results.select("source_file", F.inline("checks")).select("source_file", "field", "status", "message")


def traces_table(results: DataFrame) -> DataFrame:
    """Steps of traces, numbered from one."""
    return results.select("source_file", F.posexplode("trace").alias("at", "message")).select("source_file", (F.col("at") + 1).cast("int").alias("step_number"), "message")


def log_uploads(uploads: DataFrame, root: str, at: Column | None = None) -> DataFrame:
    """Appends (original_filename, upload_path, file_size_bytes) to the upload log; returns what was appended."""
    rows = uploads.select("original_filename", "upload_path", F.col("file_size_bytes").cast("long").alias("file_size_bytes"), (at if at is not None else _now()).alias("processed_at"))
    rows.write.mode("append").parquet(f"{root}/pdf_uploads")
    return rows


def log_errors(errors: DataFrame, root: str, at: Column | None = None) -> DataFrame:
    """Appends (error_type, source, message, severity) to the error log, severity ``error`` where it is missing."""
    severity = F.coalesce(F.col("severity"), F.lit("error")) if "severity" in errors.columns else F.lit("error")
    rows = errors.select("error_type", "source", severity.alias("severity"), "message", (at if at is not None else _now()).alias("logged_at"))
    rows.write.mode("append").parquet(f"{root}/error_log")
    return rows


def latest(log: DataFrame, at: str, tie: list[str], limit: int = 200) -> DataFrame:
    """The latest rows of a log; ``tie`` orders rows of one time."""
    return log.orderBy(F.desc(at), *[F.desc(c) for c in tie]).limit(limit)


def document_errors(log: DataFrame) -> DataFrame:
    return log.filter(F.col("error_type") == "document_processing")


def system_errors(log: DataFrame) -> DataFrame:
    return log.filter(F.col("error_type").isin("infrastructure", "code"))


def reset(spark: SparkSession, root: str, templates: str | None = None, outputs: str | None = None) -> None:
    """Empties every table and the template store and removes outputs; bad patterns stay."""
    for name, schema in schemas().items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if templates:
        path = jvm.org.apache.hadoop.fs.Path(templates)
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(bytearray(b"[]"))
        stream.close()
    if outputs:
        path = jvm.org.apache.hadoop.fs.Path(outputs)
        path.getFileSystem(conf).delete(path, True)


def save_selection(spark: SparkSession, selection: catalog.Selection, path: str) -> None:
    """A selection as an indented JSON file, in the place that ``read_selection`` reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, True)
    stream.write(bytearray(json.dumps(selection, indent=2).encode("utf-8")))
    stream.close()


def file_logger(folder: str, name: str = "formloom") -> logging.Logger:
    """The driver's log file; asked for again, the same logger."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handler = logging.FileHandler(Path(folder) / "pipeline.log", encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-8s — %(message)s", datefmt="%Y-%m-%dT%H:%M:%SZ"))
        logger.setLevel(logging.DEBUG)
        logger.addHandler(handler)
    return logger
