"""An extension beyond batches: the same findings and redaction over a stream of texts. Row-wise expressions need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.privacy import RULES, redacted


def redacted_stream(texts: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """A streaming (or batch) frame with its text redacted."""
    return texts.withColumn(text, redacted(F.col(text), rules))


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in each window, late ones up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
