"""Fitted models on a stream: nothing is learned, so every micro-batch is a projection or a static join."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_stream(
    source: DataFrame, model: Transformer, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Transform a streaming DataFrame with a fitted model and append the rows to Parquet."""
    writer = model.transform(source).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
