"""Dates of queries as UTC seconds; ``now`` is always given, so that a query has one answer."""

from __future__ import annotations

import re
from datetime import datetime, timezone

DAY = 86_400
TOKENS = {"today": 0, "yesterday": 1, "week": 7, "month": 30, "year": 365}


def iso_seconds(text: str) -> int | None:
    """YYYY, YYYY-MM or YYYY-MM-DD as midnight UTC."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", text)
    if not m:
        return None
    try:
        return int(datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def token_range(token: str, now: int) -> tuple[int, int] | None:
    """(from, to) of a named span: today since midnight, yesterday the day before it, others so many days back."""
    days = TOKENS.get(token.lower())
    if days is None:
        return None
    midnight = now - now % DAY
    if token.lower() == "today":
        return midnight, now
    if token.lower() == "yesterday":
        return midnight - DAY, midnight - 1
    return now - days * DAY, now
