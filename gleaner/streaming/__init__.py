"""Row-local detectors on streams: missing values, and outliers by limits fitted on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import is_missing, number
from gleaner.operators.detectors import GATE, SIGMAS, flagged, profile


def fit_limits(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and largest distance of each column that has enough numbers that differ."""
    return {c: (s["mean"], SIGMAS * s["sd"]) for c, s in profile(df, columns).items() if s["numbers"] >= GATE and s["sd"]}


def stream_errors(stream: DataFrame, limits: dict[str, tuple[float, float]], columns: list[str]) -> DataFrame:
    """(row_id, column_id, error_type) as rows arrive; needs no state."""
    far = {c: F.abs(number(stream, c) - F.lit(m)) > F.lit(d) for c, (m, d) in limits.items()}
    return flagged(stream, {c: is_missing(stream, c) for c in columns}, "missing").unionByName(flagged(stream, far, "anomaly"))
