"""Streaming ingestion of collected rollouts and windowed quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftlens.schema import ROLLOUT
from shiftlens.sources.tables import ROLLOUT_RULES


def stream_rollouts(
    spark: SparkSession,
    folder: str,
    *,
    schema: str = ROLLOUT,
    file_format: str = "json",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Read rollout files as they arrive."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_ingest(
    rollouts: DataFrame,
    *,
    rules: Mapping[str, str] = ROLLOUT_RULES,
    time: str = "created_at",
    delay: str = "1 day",
    key: str = "rollout_id",
) -> DataFrame:
    """Keep valid rollouts and drop repeats of an id (within the watermark on a stream)."""
    valid = rollouts
    for rule in rules.values():
        valid = valid.filter(F.coalesce(F.expr(rule), F.lit(False)))
    if not valid.isStreaming:
        return valid.dropDuplicates([key])
    return valid.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """Append a stream to parquet, exactly once through the checkpoint folder."""
    writer = rows.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def _quality(
    max_truncation: float, max_errors: int
) -> tuple[list[Column], list[Column]]:
    status = F.col("status")
    counts = [
        F.count("*").alias("rollouts"),
        F.count_if(status == "clean_stop").alias("clean_stop"),
        F.count_if(status == "length_truncated").alias("truncated"),
        F.count_if(status == "parse_invalid").alias("parse_invalid"),
        F.count_if(status == "malformed").alias("malformed"),
    ]
    rate = F.col("truncated") / F.col("rollouts")
    alert = (rate > max_truncation) | (F.col("malformed") >= max_errors)
    return counts, [rate.alias("truncation_rate"), alert.alias("alert")]


def window_quality(
    rollouts: DataFrame,
    *,
    time: str = "created_at",
    width: str = "1 hour",
    delay: str | None = None,
    max_truncation: float = 0.1,
    max_errors: int = 5,
) -> DataFrame:
    """Count statuses per tumbling window with an alert; ``delay`` sets a stream's watermark."""
    rows = rollouts.withWatermark(time, delay) if delay else rollouts
    counts, derived = _quality(max_truncation, max_errors)
    windows = rows.groupBy(F.window(time, width)).agg(*counts)
    return windows.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "rollouts", "clean_stop", "truncated", "parse_invalid", "malformed",
        *derived,
    )
