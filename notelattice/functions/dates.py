"""Relative and absolute time expressions, resolved on the driver before a query."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

DAY = 86_400
# Spellings of the units and their seconds; a month has 30 days, a year 365.
UNITS = {
    1: "s sec secs second seconds", 60: "m min mins minute minutes", 3600: "h hr hrs hour hours", DAY: "d day days", 7 * DAY: "w wk wks week weeks",
    30 * DAY: "mo mon month months", 365 * DAY: "y yr yrs year years",
}
SECONDS = {name: n for n, names in UNITS.items() for name in names.split()}


def absolute(text: str) -> datetime:
    """An ISO 8601 date or instant; without an offset it is local time."""
    try:
        got = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"not a date: {text!r}") from e
    return got if got.tzinfo else got.astimezone()


def resolve(text: str, now: datetime) -> datetime:
    """now, today, yesterday, last <unit>, <n><unit> [ago], or an ISO date."""
    text = text.strip()
    low = text.lower()
    if low == "now":
        return now
    if low in ("today", "yesterday"):
        return now - timedelta(days=1)
    if low.startswith("last ") and low[5:].strip() in SECONDS:
        return now - timedelta(seconds=SECONDS[low[5:].strip()])
    if "-" in text or ":" in text:
        return absolute(text)
    m = re.fullmatch(r"\+?\s*(\d+)\s*([a-z]+)(?:\s+ago)?", low)
    if not m or m[2] not in SECONDS:
        raise ValueError(f"unknown timeframe {text!r}")
    return now - timedelta(seconds=int(m[1]) * SECONDS[m[2]])


def normalize_timeframe(text: str, now: datetime | None = None) -> str:
    """today, or whole days back like 7d; the future and more than a year are refused."""
    now = now or datetime.now(UTC)
    if text.strip().lower() == "today":
        return "today"
    at = resolve(text, now)
    if at > now:
        raise ValueError("timeframe cannot be in the future")
    days = round((now - at).total_seconds() // 1 / DAY)
    if days > 365:
        raise ValueError("timeframe should be <= 1 year")
    return f"{days}d"


def parse_timeframe(text: str, now: datetime | None = None) -> datetime:
    """The bound of a timeframe: at least one day back."""
    now = now or datetime.now(UTC)
    floor = now - timedelta(days=1)
    return min(floor, floor if text.strip().lower() == "today" else resolve(text, now))


def since_bound(at: datetime) -> str:
    """The bound as text, compared with stored timestamps as text: rows of its own day come before it."""
    return at.isoformat()


def storage_timestamp(at: datetime) -> str:
    return at.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")


def _months_back(at: datetime, n: int) -> datetime:
    month = at.year * 12 + at.month - 1 - n
    year, month = divmod(month, 12)
    for day in range(at.day, 0, -1):
        try:
            return at.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    raise ValueError("no such month")


def parse_after_date(text: str, now: datetime | None = None) -> datetime | None:
    """The bound of a search: calendar months and years; unknown expressions are no filter."""
    now = now or datetime.now(UTC)
    low = text.strip().lower()
    if low in ("now", "today"):
        return now
    if low == "yesterday":
        return now - timedelta(days=1)
    m = re.fullmatch(r"(\d+)\s*([a-z]+)(?:\s+ago)?", low) or re.fullmatch(r"()last\s+([a-z]+)", low)
    if m and m[2] in SECONDS:
        n, size = int(m[1] or 1), SECONDS[m[2]]
        if size >= 30 * DAY:
            return _months_back(now, n * (12 if size == 365 * DAY else 1))
        return now - timedelta(seconds=n * size)
    try:
        got = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return got if got.tzinfo else got.replace(tzinfo=UTC)
