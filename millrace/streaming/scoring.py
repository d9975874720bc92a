"""Scoring a stream with fitted features: they are column expressions and joins with static tables, so a streaming
DataFrame goes through the same code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append apply(stream) to Parquet files; the checkpoint makes each row appear once."""
    return apply(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
