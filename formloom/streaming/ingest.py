"""The batch transformations over a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(
    spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Runs ``transform`` on each batch of new Parquet files; a batch that is repeated overwrites its own folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    rows = spark.readStream.schema(schema).parquet(path)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
