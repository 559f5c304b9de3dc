"""The flagship flow: fill gaps, drop outliers, encode, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.operators.encode import fit_encoder
from tidemill.operators.impute import fit_value_fill
from tidemill.operators.outliers import fit_outliers


def prepare_events(events: DataFrame) -> DataFrame:
    """Per category: rows, its share of all rows and the mean of the cleaned value."""
    filled = fit_value_fill(events, "value", "median").transform(events)
    kept = fit_outliers(filled, "value", "iqr").transform(filled)
    encoded = fit_encoder(kept, "event_type", "frequency", drop_original=False).transform(kept)
    return encoded.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("event_type_freq"), 6).alias("share"),
        F.round(F.avg("value"), 4).alias("mean_value"))
