"""Sinks: JSON, CSV and Parquet, with lists and structs encoded where a format has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_nested(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text; nulls inside stay."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    if form == "csv":
        encode_nested(df).write.mode(mode).csv(path, header=True)
    elif form == "json":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode(mode).parquet(path)
