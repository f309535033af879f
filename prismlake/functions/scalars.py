"""Dates, numbers and states as expressions."""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 24 * 60 * 60
RECENT_DAYS = 30


def filter_time() -> Column:
    """C1 for filters: null where a photo has no date, or one too large for milliseconds."""
    return F.coalesce(F.col("dateTaken"), F.try_multiply(F.col("dateAdded"), F.lit(1000).cast("long")))


def rank_time() -> Column:
    """C1 for ordering: 0 where a photo has no date."""
    return F.coalesce(F.col("dateTaken"), F.try_multiply(F.coalesce("dateAdded", F.lit(0).cast("long")), F.lit(1000).cast("long")))


def match_percentage(similarity: Column) -> Column:
    """-1..1 to 0..100, halves up."""
    return F.floor((F.least(F.greatest(similarity, F.lit(-1.0)), F.lit(1.0)) + 1) * 50 + 0.5).cast("int")


def display_date(millis: Column) -> Column:
    """C3, in the session's time zone."""
    return F.coalesce(F.date_format(F.timestamp_millis(millis), "MMM d, yyyy • h:mm a"), F.lit("Date unavailable"))


def bounded_scale(width: Column, height: Column, most: int) -> Column:
    """The factor that brings the longer side to ``most``, never above 1."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


def bounded_size(width: Column, height: Column, most: int) -> Column:
    """Width and height of a shrunk image, at least 1."""
    scale = bounded_scale(width, height, most)
    return F.struct(*(F.greatest(F.lit(1), F.floor(x * scale).cast("int")).alias(n) for n, x in (("width", width), ("height", height))))


def remaining(total: Column, indexed: Column) -> Column:
    """C9."""
    return F.greatest(total - indexed, F.lit(0))


def results_label(n: Column, most: int = 100) -> Column:
    """C9."""
    return F.when(n == most, F.lit(f"Top {most} results")).otherwise(F.concat(n.cast("string"), F.lit(" results")))


# fixed values: labels of enumerations
LABELS = {
    "ANY_TIME": "Any time", "TODAY": "Today", "YESTERDAY": "Yesterday", "THIS_WEEK": "This week", "THIS_MONTH": "This month", "CUSTOM": "Custom range",
    "MOST_RELEVANT": "Most relevant", "NEWEST_FIRST": "Newest first", "OLDEST_FIRST": "Oldest first", "NORMAL": "Normal query", "OCR": "OCR search",
}


def label(value: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[value]


def indexing_status(counts_loaded: Column, model_error: Column, worker: Column, worker_total: Column, work: Column, indexed: Column, faces: Column, total: Column) -> Column:
    """C4: the first rule that holds."""
    done = F.least(indexed, faces)
    return (
        F.when(~counts_loaded, "Idle")
        .when(model_error.isNotNull() | F.coalesce(worker == "UNAVAILABLE", F.lit(False)), "Unavailable")
        .when((total == 0) | (done >= total), "Idle")
        .when(work.isin("ENQUEUED", "BLOCKED"), "Waiting")
        .when(work == "RUNNING", "Running")
        .when((worker == "INTERRUPTED") & (worker_total == total), "Interrupted")
        .otherwise("Waiting")
    )


def text_status(count_loaded: Column, worker: Column, worker_total: Column, work: Column, indexed: Column, total: Column) -> Column:
    """C4 for the text pass, which waits while it is queued behind the others."""
    return (
        F.when(~count_loaded | (total == 0) | (indexed >= total), "Idle")
        .when(work.isin("ENQUEUED", "BLOCKED"), "Waiting")
        .when((work == "RUNNING") & (worker == "QUEUED"), "Waiting")
        .when(work == "RUNNING", "Running")
        .when((worker == "INTERRUPTED") & (worker_total == total), "Interrupted")
        .otherwise("Waiting")
    )


def incomplete(mode: Column, query: Column, indexed: Column, text_indexed: Column, face_indexed: Column, total: Column) -> Column:
    """C11: which parts of an answer may be missing."""
    return F.struct(
        ((mode == "NORMAL") & (indexed < total)).alias("visual"),
        ((mode == "OCR") & (text_indexed < total)).alias("text"),
        (F.contains(query, F.lit("@")) & (face_indexed < total)).alias("faces"),
    )


def day_start(day: date, zone: str) -> int:
    """Epoch milliseconds at which a local day begins: of two midnights the earlier, of none the first moment after."""
    return int(datetime.combine(day, time(), ZoneInfo(zone)).timestamp() * 1000)


def date_bounds(time_range: str, now_millis: int, zone: str = "UTC", first_weekday: int = 0, custom: tuple[int | None, int | None] = (None, None)) -> tuple[int | None, int | None]:
    """P5: [start, end) in milliseconds; ``first_weekday`` counts from Monday, 0."""
    if time_range == "CUSTOM":
        return custom
    if time_range == "ANY_TIME":
        return None, None
    today = datetime.fromtimestamp(now_millis / 1000, ZoneInfo(zone)).date()
    week = today - timedelta(days=(today.weekday() - first_weekday) % 7)
    month = today.replace(day=1)
    spans = {
        "TODAY": (today, today + timedelta(days=1)),
        "YESTERDAY": (today - timedelta(days=1), today),
        "THIS_WEEK": (week, week + timedelta(days=7)),
        "THIS_MONTH": (month, (month + timedelta(days=32)).replace(day=1)),
    }
    if time_range not in spans:
        raise ValueError(f"unknown time range {time_range}")
    return tuple(day_start(d, zone) for d in spans[time_range])


def picked_range(start_utc_millis: int, end_utc_millis: int, zone: str) -> tuple[int, int]:
    """Days picked as UTC dates, from the first one's local midnight to the end of the last."""
    first, last = (datetime.fromtimestamp(m / 1000, UTC).date() for m in (start_utc_millis, end_utc_millis))
    return day_start(first, zone), day_start(last + timedelta(days=1), zone)


def recent_cutoff(now_millis: int) -> int:
    """Seconds, truncated toward zero."""
    return int((now_millis - RECENT_DAYS * DAY * 1000) / 1000)
