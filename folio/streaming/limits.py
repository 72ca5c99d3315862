"""Counters of fixed windows over a stream of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folio.operators.runs import windows


def counters(events: DataFrame, seconds: int, late: str, key: list[str], at: str = "ts") -> DataFrame:
    """Counts by key in windows aligned to the epoch; a window's state goes once the watermark has passed it."""
    return windows(events.withWatermark(at, late), seconds, key, at)


def submissions(events: DataFrame, late: str, at: str = "ts") -> DataFrame:
    """Submissions once for each (tenant_id, idempotency_key): a replay within the watermark is dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"])
