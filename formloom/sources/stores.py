"""Scans of what is stored: templates, bad patterns, selections, traces, tables; and the settings.

A store that is missing or no valid JSON is empty, so that a first run needs no preparation.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import Selection, default_selection

_TEMPLATES = (
    "array<struct<template_name:string,document_type:string,signature:struct<zone_density:array<double>>,anchors:map<string,struct<label:string,pattern:string>>,"
    "spatial_anchors:array<struct<field:string,label_text:string,norm_x:double,norm_y:double>>>>"
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row, ``v``, of a JSON file; none if it is missing or corrupt."""
    try:
        return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("v")).filter("v is not null")
    except AnalysisException:  # no such path
        return spark.createDataFrame([], f"v {schema}")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """document_type, ord, template_name, vector, anchors (field to pattern), labels, spatial_anchors of a template store."""
    rows = _json(spark, path, _TEMPLATES).select(F.posexplode("v").alias("ord", "t"))
    part = lambda k: F.coalesce(F.transform_values("t.anchors", lambda _, a: a[k]), F.create_map().cast("map<string,string>"))
    return rows.select(
        F.coalesce("t.document_type", F.lit("invoice")).alias("document_type"), F.col("ord").cast("long").alias("ord"), "t.template_name",
        F.coalesce("t.signature.zone_density", F.array().cast("array<double>")).alias("vector"), part("pattern").alias("anchors"), part("label").alias("labels"),
        "t.spatial_anchors",
    )


def read_bad_patterns(spark: SparkSession, path: str) -> DataFrame:
    """document_type, field, ord, pattern of a store whose keys are ``type.field``."""
    rows = _json(spark, path, "map<string,array<string>>").select(F.explode("v").alias("k", "p"))
    split = lambda i: F.get(F.split("k", r"\.", 2), F.lit(i))
    return rows.select(split(0).alias("document_type"), split(1).alias("field"), F.posexplode("p").alias("ord", "pattern"))


def read_selection(spark: SparkSession, path: str) -> Selection:
    """Selected fields by type, at most a few hundred names; the defaults if there are none stored."""
    row = _json(spark, path, "map<string,array<string>>").first()
    return {k: list(v) for k, v in row["v"].items()} if row else default_selection()


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stored table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def trace_of(traces: DataFrame, source_file: str) -> DataFrame:
    """The steps of one document in order."""
    return traces.filter(F.col("source_file") == source_file).orderBy("step_number").select("message")


def traces_by_document(traces: DataFrame) -> DataFrame:
    """source_file, trace: the steps of each document in order; a document's steps are a few dozen."""
    ordered = F.array_sort(F.collect_list(F.struct("step_number", "message")))
    return traces.groupBy("source_file").agg(F.transform(ordered, lambda x: x["message"]).alias("trace"))


@dataclass(frozen=True)
class Settings:
    """What the engine is told by its environment."""

    environment: str = "dev"
    data_dir: str = "data/dev"
    learning: bool = True
    least_passed: float = 0.6
    provider: str = "openai"
    base_url: str | None = None
    api_key: str | None = None
    model: str = "gpt-4.1-mini"

    @property
    def templates(self) -> str:
        return f"{self.data_dir}/learned_templates.json"

    @property
    def bad_patterns(self) -> str:
        return f"{self.data_dir}/bad_patterns.json"

    @property
    def selection(self) -> str:
        return f"{self.data_dir}/schema_settings.json"


def load_settings(env: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ) if env is None else env
    name = env.get("APP_ENV", "dev").strip().lower()
    return Settings(
        environment=name,
        data_dir=env.get("APP_DATA_DIR", f"{env.get('APP_DATA_ROOT', 'data')}/{name}"),
        learning=env.get("ENABLE_TEMPLATE_LEARNING", "true").lower() == "true",
        least_passed=float(env.get("MIN_LEARNING_PASS_RATIO", "0.6")),
        provider=env.get("LLM_PROVIDER", "openai").strip().lower(),
        base_url=env.get("LLM_BASE_URL"),
        api_key=env.get("OPENAI_API_KEY"),
        model=env.get("OPENAI_MODEL", "gpt-4.1-mini"),
    )
