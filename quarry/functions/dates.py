"""Dates counted from 1960, intervals, and date formats."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import NonConvertible

#: Days and seconds from 1960-01-01 to 1970-01-01.
EPOCH_DAYS, EPOCH_SECONDS = 3653, 315_619_200
#: Months of the month-based intervals.
MONTHS = {"MONTH": 1, "QTR": 3, "SEMIYEAR": 6, "YEAR": 12}
DAYS = {"DAY": 1, "WEEK": 7}
#: Date formats and their patterns.
PATTERNS = {"DATE9.": "ddMMMyyyy", "YYMMDD10.": "yyyy-MM-dd", "YYMMDDN8.": "yyyyMMdd", "MMDDYY10.": "MM/dd/yyyy", "DDMMYY10.": "dd/MM/yyyy", "MONYY7.": "MMMyyyy", "YEAR4.": "yyyy"}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def from_days(n) -> Column:
    return F.date_add(F.lit(dt.date(1960, 1, 1)), _col(n).cast("int"))


def to_days(d) -> Column:
    return F.datediff(_col(d), F.lit(dt.date(1960, 1, 1)))


def from_seconds(n) -> Column:
    """A wall-clock timestamp."""
    return F.timestamp_seconds(_col(n) - EPOCH_SECONDS).cast("timestamp_ntz")


def literal(text: str) -> Column:
    """'01JAN2020'd, '01JAN2020:10:11:12'dt and '10:11:12't, read when the plan is built."""
    m = re.fullmatch(r"(['\"])(.*)\1(d|dt|t)", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a date literal: {text}")
    body, kind = m[2], m[3].lower()
    if kind == "d":
        return F.lit(dt.datetime.strptime(body, "%d%b%Y").date())
    if kind == "dt":
        return F.lit(str(dt.datetime.strptime(body, "%d%b%Y:%H:%M:%S"))).cast("timestamp_ntz")
    h, mi, *s = body.split(":")
    return F.lit(float(int(h) * 3600 + int(mi) * 60 + (float(s[0]) if s else 0)))


def weekday(d) -> Column:
    """1 is Sunday."""
    return F.dayofweek(_col(d))


def mdy(m, d, y) -> Column:
    return F.make_date(_col(y), _col(m), _col(d))


def hms(h, m, s) -> Column:
    return (_col(h) * 3600 + _col(m) * 60 + _col(s)).cast("double")


def timepart(t) -> Column:
    return (F.hour(_col(t)) * 3600 + F.minute(_col(t)) * 60 + F.second(_col(t))).cast("double")


def _start(d: Column, months: int) -> Column:
    unit = {1: "month", 3: "quarter", 12: "year"}.get(months)
    if unit:
        return F.trunc(d, unit)
    return F.add_months(F.trunc(d, "year"), F.floor((F.month(d) - 1) / months).cast("int") * months)


def intnx(interval: str, start, n, align: str = "BEGINNING") -> Column:
    """start moved by n intervals; BEGINNING, END or SAME within the interval."""
    d, n, interval = _col(start).cast("date"), _col(n) if not isinstance(n, int) else F.lit(n), interval.upper()
    align = {"B": "BEGINNING", "E": "END", "S": "SAME"}.get(align.upper(), align.upper())
    if interval in MONTHS:
        k = MONTHS[interval]
        if align == "SAME":
            return F.add_months(d, (n * k).cast("int"))
        first = F.add_months(_start(d, k), (n * k).cast("int"))
        return first if align == "BEGINNING" else F.date_sub(F.add_months(first, k), 1)
    if interval == "DAY":
        return F.date_add(d, n.cast("int"))
    if interval == "WEEK":
        base = d if align == "SAME" else F.date_sub(d, (F.dayofweek(d) - 1).cast("int"))
        moved = F.date_add(base, (n * 7).cast("int"))
        return F.date_add(moved, 6) if align == "END" else moved
    raise NonConvertible(f"interval {interval}")


def intck(interval: str, start, end) -> Column:
    """How many interval boundaries lie between start and end."""
    a, b, interval = _col(start).cast("date"), _col(end).cast("date"), interval.upper()
    if interval in MONTHS:
        number = lambda d: F.floor((F.year(d) * 12 + F.month(d) - 1) / MONTHS[interval])
        return (number(b) - number(a)).cast("int")
    if interval == "DAY":
        return F.datediff(b, a)
    if interval == "WEEK":
        week = lambda d: F.floor((to_days(d) + 5) / 7)  # noqa: E731  1960-01-01 was a Friday
        return (week(b) - week(a)).cast("int")
    raise NonConvertible(f"interval {interval}")


def put_date(d, fmt: str) -> Column:
    if fmt.upper() not in PATTERNS:
        raise NonConvertible(f"format {fmt}")
    out = F.date_format(_col(d), PATTERNS[fmt.upper()])
    return F.upper(out) if "MMM" in PATTERNS[fmt.upper()] else out


def input_date(s, fmt: str) -> Column:
    """Missing where the text is no such date."""
    if fmt.upper() not in PATTERNS:
        raise NonConvertible(f"informat {fmt}")
    text = F.initcap(F.regexp_replace(_col(s), r"(\d)([A-Za-z])", "$1 $2")) if "MMM" in PATTERNS[fmt.upper()] else _col(s)
    pattern = PATTERNS[fmt.upper()].replace("ddMMM", "dd MMM")
    return F.try_to_date(text, pattern)


def holiday(d, calendar) -> Column:
    """Whether d is one of the calendar's dates (a list read at plan time)."""
    if not calendar:
        raise NonConvertible("holiday functions need a calendar")
    return _col(d).isin(list(calendar)).cast("int")


def today() -> Column:
    """The date at the start of the query, in days from 1960."""
    return to_days(F.current_date())


def datetime() -> Column:
    """The time at the start of the query, in seconds from 1960."""
    return F.unix_timestamp(F.current_timestamp()) + EPOCH_SECONDS


def dhms(d, h, m, s) -> Column:
    """Seconds from 1960 of a day (in days from 1960) and a time."""
    return _col(d) * 86_400 + _col(h) * 3600 + _col(m) * 60 + _col(s)
