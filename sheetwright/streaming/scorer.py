"""Scoring of responses as they arrive: an extension, since batch reports are what the engine is for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import correct, parse_first


def score_stream(responses: DataFrame, truths: DataFrame, key: str, path: str, checkpoint: str, tolerance: float = 0.1) -> StreamingQuery:
    """Join a stream of (key, response) with a table of (key, truth), score, and append to a Parquet table."""
    joined = responses.join(truths, key, "left")
    predicted = parse_first(F.col("response"))[0]
    scored = joined.withColumn("predicted", predicted).withColumn("correct", correct(F.col("predicted"), F.col("truth"), tolerance))
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
