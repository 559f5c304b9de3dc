"""Fitted transforms on a stream: they are row-wise, so the model fitted on a table applies as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame


def transform_stream(stream: DataFrame, fitted: list) -> DataFrame:
    """Apply fitted objects, in order, to a streaming (or batch) DataFrame."""
    for step in fitted:
        stream = step.transform(stream)
    return stream
