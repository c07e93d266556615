"""Progress events and checkpointed work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.library import latest


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each id; on a stream, an aggregation to be written in
    update mode."""
    return latest(events, ["id"], ["ts", "event_id"])


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per window and state, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "state").count()


def usable_records(records: DataFrame, identity: str) -> DataFrame:
    """Checkpointed pages of the same identity; damaged rows are left out."""
    return records.where((F.col("identity") == identity) & F.col("page").isNotNull() & F.col("seconds").isNotNull())


def remaining(pages: DataFrame, records: DataFrame) -> DataFrame:
    return pages.join(records.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
