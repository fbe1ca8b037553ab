"""Dates as people write them: a small grammar over classified tokens, for what isn't ISO 8601.

A time of day with its zone is taken out first; of the other tokens, words are months, weekdays, zones or fillers, and numbers become day,
month and year by these rules: with a month's name, a number over 31 or of four digits is the year, else day comes before year; without
one, a leading year is followed by month and day, else month comes before day unless it is over 12. Years of two digits are 1970 to
2069. Unknown zone names after a time count as UTC. No clock is consulted: a text without a year, or with a word that is none of
these, is no date, nor is an impossible one.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, functions as F

from presswork import schema

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
FILLERS = {"of", "at", "on", "the", "st", "nd", "rd", "th", "t"}
COMPACT = re.compile(r"(\d{4})(\d\d)(\d\d)(?:[t ]?(\d\d)(\d\d)(\d\d)?(?:[.,](\d{1,9}))?)?\s*(z|[+-]\d\d:?\d\d)?$")
CLOCK = re.compile(r"(?<![\d.:])(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?!\d)(?:\s*([ap])\.?m\b\.?)?")
HOUR = re.compile(r"(?<![\d.:])(\d{1,2})\s*([ap])\.?m\b\.?")
OFFSET = re.compile(r"\s*(?:utc|gmt|z)?\s*([+-])(\d\d):?(\d\d)?(?!\d)")
TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")


def _minutes(sign: str, hours: str, minutes: str | None) -> int:
    return (int(hours) * 60 + int(minutes or 0)) * (-1 if sign == "-" else 1)


def _micros(fraction: str | None) -> int:
    return int((fraction or "").ljust(6, "0")[:6])


def _century(number: str) -> int:
    return int(number) if len(number) > 2 else int(number) + (2000 if int(number) < 70 else 1900)


def _day(month: int | None, numbers: list[str]) -> tuple[int, int, int] | None:
    """Year, month and day from a month's name, if any, and the numbers in their order."""
    year_like = [len(n) > 2 or int(n) > 31 for n in numbers]
    if month:
        if len(numbers) == 1 and year_like[0]:
            return _century(numbers[0]), month, 1
        if len(numbers) == 2:
            year, day = numbers if year_like[0] else reversed(numbers)
            return _century(year), month, int(day)
    elif len(numbers) == 3:
        if year_like[0]:
            year, a, b = numbers
            return _century(year), *((int(a), int(b)) if int(a) <= 12 else (int(b), int(a)))
        a, b, year = numbers
        return _century(year), *((int(a), int(b)) if int(a) <= 12 else (int(b), int(a)))
    elif len(numbers) == 2 and sum(len(n) == 4 for n in numbers) == 1:
        year, only = numbers if len(numbers[0]) == 4 else reversed(numbers)
        return int(year), int(only), 1
    return None


def parse(text: str) -> datetime | None:
    """The moment in UTC, without a zone of its own."""
    t = text.strip().lower()
    offset, clock, zoned = 0, (0, 0, 0, 0), False
    if found := COMPACT.match(t):
        year, month, day, hour, minute, second, fraction, zone = found.groups()
        clock = int(hour or 0), int(minute or 0), int(second or 0), _micros(fraction)
        offset = _minutes(zone[0], zone[1:3], zone[-2:]) if zone and zone != "z" else 0
        return _moment((int(year), int(month), int(day)), clock, offset)
    t = re.sub(r"(?<=\d)t(?=\d)", " ", t)
    after = ""
    if found := CLOCK.search(t):
        hour, minute, second, fraction, half = found.groups()
    elif found := HOUR.search(t):
        hour, half = found.groups()
        minute = second = fraction = None
    if found:
        if half and not 1 <= int(hour) <= 12:
            return None
        clock = int(hour) % 12 + (12 if half == "p" else 0) if half else int(hour), int(minute or 0), int(second or 0), _micros(fraction)
        t, after = t[: found.start()], t[found.end() :]
        if zone := OFFSET.match(after):
            offset, zoned, after = _minutes(*zone.groups()), True, after[zone.end() :]
    month, numbers = None, []
    for token, late in [(x, False) for x in TOKEN.findall(t)] + [(x, True) for x in TOKEN.findall(after)]:
        named = next((k for k, name in enumerate(MONTHS, 1) if len(token) > 2 and name.startswith(token)), None)
        if token.isdecimal():
            numbers.append(token)
        elif named and month is None:
            month = named
        elif token in FILLERS or (len(token) > 1 and any(d.startswith(token) for d in WEEKDAYS)) or token in ",./-()'":
            continue
        elif token.upper() in schema.ZONES and not zoned:
            zone = schema.ZONES[token.upper()]
            offset, zoned = _minutes(zone[0], zone[1:3], zone[3:]), True
        elif late and not zoned and token.isalpha() and 2 <= len(token) <= 5:
            zoned = True
        else:
            return None
    day = _day(month, numbers)
    return _moment(day, clock, offset) if day else None


def _moment(day: tuple[int, int, int], clock: tuple[int, int, int, int], offset: int) -> datetime | None:
    try:
        return datetime(*day, *clock) - timedelta(minutes=offset)
    except (ValueError, OverflowError):
        return None


def free_date(text: Column) -> Column:
    """A timestamp, or null; null texts cost nothing."""

    def micros(texts: pd.Series) -> pd.Series:
        zero = datetime(1970, 1, 1)
        found = [None if t is None else parse(t) for t in texts]
        return pd.Series([None if d is None else (d - zero) // timedelta(microseconds=1) for d in found], dtype="Int64")

    return F.timestamp_micros(F.pandas_udf(micros, "long")(text))
