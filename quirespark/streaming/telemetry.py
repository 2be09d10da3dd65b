"""Telemetry as a stream: windowed aggregates and an append sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirespark.operators.monitoring import record_issues, windowed

RECORD = "record_id long, ts timestamp, stage string, status string, duration_seconds double"


def stream(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records that arrive as parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def start_windows(records: DataFrame, name: str, size: str = "1 hour", late: str = "10 minutes", checkpoint: str | None = None) -> StreamingQuery:
    """Windowed aggregates of a stream in an in-memory table, each window once, when it is final."""
    writer = windowed(records, size, late).writeStream.outputMode("append").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def start_hook(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch of records that meet their contract, with its number, to a sink of one's own. A batch comes again after a failure, under the same number; records that break the contract never reach the
    sink (see ``monitoring.record_issues``)."""

    def checked(batch: DataFrame, number: int) -> None:
        bad = record_issues(batch).select("record_id").distinct()
        write(batch.join(bad, "record_id", "left_anti"), number)

    return records.writeStream.foreachBatch(checked).option("checkpointLocation", checkpoint).start()


def start_sink(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every record to a parquet table exactly once."""
    return records.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
