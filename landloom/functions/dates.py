"""Dates, check times, freshness and health as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BACKOFF_S = 6 * 3600


def _try_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def parse_date(text: Column) -> Column:
    """The first ten characters as an ISO date, else null."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), _try_date(head))


def strict_date(text: Column) -> Column:
    """A whole ISO date; a year or a year and month alone don't parse."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}"), parse_date(F.trim(text)))


def vietnamese_date(text: Column) -> Column:
    """dd/mm/yyyy or "ngày d tháng m năm y" (folded or not) -> date."""
    slash, words = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(?i)ng[àa]y\s+(\d{1,2})\s+th[áa]ng\s+(\d{1,2})\s+n[ăa]m\s+(\d{4})"
    part = lambda i, n: F.lpad(F.coalesce(F.nullif(F.regexp_extract(text, slash, i), F.lit("")), F.nullif(F.regexp_extract(text, words, i), F.lit(""))), n, "0")
    return _try_date(F.concat_ws("-", part(3, 4), part(2, 2), part(1, 2)))


def next_check_at(now: Column, interval_s: Column, failed: Column, failures: Column, source_id: Column, jitter_s: int = 300, multiplier: float = 2.0, cap_s: int = MAX_BACKOFF_S) -> Column:
    """now + interval, grown by the failures and capped after a failure; jitter is drawn from the source's id."""
    base = F.coalesce(interval_s, F.lit(86400)).cast("double")
    wait = F.when(failed, F.least(base * F.pow(F.lit(multiplier), F.least(failures, F.lit(6))), F.lit(float(cap_s)))).otherwise(base)
    jitter = F.pmod(F.conv(F.substring(F.md5(source_id.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(jitter_s + 1))
    return F.timestamp_seconds(F.unix_micros(now.cast("timestamp")) / 1e6 + wait + jitter)


def freshness(last_checked: Column, last_success: Column, next_check: Column, now: Column) -> Column:
    """struct(state, due): never_checked, never_succeeded, overdue or fresh."""
    due = next_check.isNull() | (next_check <= now)
    state = F.when(last_checked.isNull(), "never_checked").when(last_success.isNull(), "never_succeeded").when(due, "overdue").otherwise("fresh")
    return F.struct(state.alias("state"), due.alias("due"))


def health(enabled: Column, blocked: Column, run_status: Column, failures: Column, had_errors: Column, needs_review: Column, had_changes: Column) -> Column:
    return (
        F.when(~enabled, "disabled").when(blocked, "blocked").when(run_status == "failed", F.when(failures >= 3, "failing").otherwise("degraded"))
        .when(had_errors, "degraded").when(needs_review, "needs_review").when(had_changes, "changed").otherwise("unchanged")
    )
