"""Time as days since 1600-01-01, partial dates, durations."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1600, 1, 1)
_EPOCH_MICROS = int((EPOCH - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
_EPOCH_JULIAN = 2_305_447.5  # Julian date of the epoch


def std_time(ts: Column) -> Column:
    """Days since 1600-01-01 of a timestamp (session time zone UTC)."""
    return (F.unix_micros(ts.cast("timestamp")) - F.lit(_EPOCH_MICROS)) / F.lit(86400e6)


def to_timestamp(days: Column) -> Column:
    return F.timestamp_micros((F.round(days * F.lit(86400e6)) + F.lit(_EPOCH_MICROS)).cast("long"))


def to_days(t: dt.datetime | dt.date) -> float:
    t = t if isinstance(t, dt.datetime) else dt.datetime(t.year, t.month, t.day)
    return (t - EPOCH) / dt.timedelta(days=1)


def seconds_since(sec: Column, reference: dt.datetime) -> Column:
    """Seconds since a reference, with its fraction of a day, as days."""
    return sec / F.lit(86400.0) + F.lit(to_days(reference))


def julian_days(jd: Column) -> Column:
    return jd - F.lit(_EPOCH_JULIAN)


#: Days in one of each unit.
UNIT_DAYS = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400, "millisecond": 1 / 86_400_000, "week": 7.0}


def cf_time(value: Column, units: str) -> Column:
    """Any `<unit>s since <date>` value as days."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(.+?)\s*", units)
    if not m or m[1].lower() not in UNIT_DAYS:
        raise ValueError(f"not a unit of time: {units!r}")
    return value * F.lit(UNIT_DAYS[m[1].lower()]) + F.lit(to_days(parse_datetime(m[2]).min()))


def mid_time(a: Column, b: Column) -> Column:
    return a + (b - a) / 2


def change_year(ts: Column, year: int) -> Column:
    """The same moment of another year; 29 February is missing in common years."""
    return F.try_make_timestamp(F.lit(year), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))


class PartialDateTime:
    """A date-time known to some field; min() and max() are its first and last whole second."""

    def __init__(self, year: int, month: int | None = None, day: int | None = None, hour: int | None = None, minute: int | None = None, second: int | None = None):
        self.fields = (year, month, day, hour, minute, second)
        known = [f is not None for f in self.fields]
        if known != sorted(known, reverse=True):
            raise ValueError("a field may be left out only with all smaller ones")
        self.min(), self.max()

    def min(self) -> dt.datetime:
        y, mo, d, h, mi, s = self.fields
        return dt.datetime(y, mo or 1, d or 1, h or 0, mi or 0, s or 0)

    def max(self) -> dt.datetime:
        y, mo, d, h, mi, s = self.fields
        mo = mo or 12
        last = lambda x, top: top if x is None else x
        return dt.datetime(y, mo, d or calendar.monthrange(y, mo)[1], last(h, 23), last(mi, 59), last(s, 59))

    def range(self) -> tuple[dt.datetime, dt.datetime]:
        return self.min(), self.max()

    def __eq__(self, other):
        return isinstance(other, PartialDateTime) and self.fields == other.fields

    def __hash__(self):
        return hash(self.fields)

    def __repr__(self):
        return f"PartialDateTime{tuple(f for f in self.fields if f is not None)}"


def parse_datetime(text: str) -> PartialDateTime:
    """YYYY[-MM[-DD[(T| |:)hh[:mm[:ss]]]]], also with / between the parts of the date, YYYYMMDD[Thhmm[ss]], or 31 Jan 2010."""
    text = text.strip()
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)?)?Z?", text):
        return PartialDateTime(*(int(x) if x else None for x in m.groups()))
    if (m := re.fullmatch(r"(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})", text)) and m[2].title() in calendar.month_abbr:
        return PartialDateTime(int(m[3]), list(calendar.month_abbr).index(m[2].title()), int(m[1]))
    text = re.sub(r"^(\d{4})/(\d{1,2})(?:/(\d{1,2}))?", lambda m: "-".join(x for x in m.groups() if x), text)
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T :](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.0*)?)?)?)?)?)?Z?", text.strip())
    if not m:
        raise ValueError(f"not a date and time: {text!r}")
    return PartialDateTime(*(int(x) if x else None for x in m.groups()))


def parse_number_or_datetime(text: str) -> float | PartialDateTime:
    """A number, or a date and time."""
    try:
        return float(text)
    except ValueError:
        return parse_datetime(text)


def parse_number_or_days(text: str) -> float:
    """A number, or a duration as days."""
    try:
        return float(text)
    except ValueError:
        return parse_duration(text) / dt.timedelta(days=1)


def parse_duration(text: str) -> dt.timedelta:
    """PnYnMnDTnHnMnS in either case, T also a space or colon; a year has 365 days and a month 30."""
    m = re.fullmatch(r"P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:[T :](?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", text.strip(), re.I)
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
    return dt.timedelta(days=365 * y + 30 * mo + d, hours=h, minutes=mi, seconds=s)


def limit_days(x, upper: bool) -> float | None:
    """A limit of the time coordinate as days: number, date, partial date or text."""
    if isinstance(x, str):
        x = parse_datetime(x)
    if isinstance(x, PartialDateTime):
        x = x.max() if upper else x.min()
    return to_days(x) if isinstance(x, dt.date) else x
