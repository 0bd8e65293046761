"""Text columns: stripping, hashing, ids, JSON contracts, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SENTIMENTS

# Every character Python's str.strip removes: Unicode white space and the four separators.
_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def collapse_spaces(text: Column | str) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(strip(text), 256)


def derived_id(prefix: str, *parts: Column | str, digits: int = 16) -> Column:
    """Deterministic id from natural keys: equal on every retry, unlike a random one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the row's compact JSON with sorted keys; NULL fields are there as null."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def valid_sentiment(sentiment: Column | str) -> Column:
    column = F.col(sentiment) if isinstance(sentiment, str) else sentiment
    return F.coalesce(column.isin(*SENTIMENTS), F.lit(False))


def non_blank(text: Column | str) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def grounded(review: Column | str, excerpt: Column | str) -> Column:
    """The excerpt is non-blank and a contiguous part of the review."""
    return non_blank(excerpt) & F.coalesce(F.contains(review, excerpt), F.lit(False))


def field_violations(payload: Column | str, expected: list[str]) -> tuple[Column, Column]:
    """(missing, unexpected) fields of a JSON object against an exact field list."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(name) for name in expected])
    return F.array_except(wanted, keys), F.array_except(keys, wanted)


def display_time(timestamp: Column | str, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(timestamp, zone), "yyyyMMdd-HHmmss")


def compact_timestamp(text: Column | str) -> Column:
    """``YYYY-MM-DDTHH:MM:SS...`` as ``YYYYMMDD-HHMMSS``; NULL where the text has another form."""
    form = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})"
    part = [F.regexp_extract(text, form, i) for i in range(1, 7)]
    joined = F.concat(*part[:3], F.lit("-"), *part[3:])
    return F.when(F.rlike(text, F.lit(form)), joined)
