"""Fitted transformers and models over streams: their expressions hold no state, so a stream is scored like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def score_stream(stream: DataFrame, model, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Predictions appended to a Parquet folder, exactly once by its checkpoint; once: what is there now, then stop."""
    scored = model.predict(stream) if hasattr(model, "predict") else model.transform(stream)
    writer = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
