"""Dates and period labels.

Rows are grouped on the first day of their period, a four-byte value; the label
is written once per group.
"""

import datetime
import re

from pyspark.sql import functions as F

GRAINS = ["day", "week", "month", "quarter", "semester", "year"]


def parse_timestamp(column):
    """Text to timestamp without zone; text that is not a time is an error."""
    return F.to_timestamp_ntz(F.col(column))


def parse_timestamp_lenient(column):
    """Text to timestamp without zone; text that is not a time is NULL."""
    return F.col(column).try_cast("timestamp_ntz")


def day_of(column):
    return F.to_date(F.col(column))


def period_start(column, grain):
    """First day of the period `column` falls in."""
    date = F.col(column)
    if grain == "day":
        return F.to_date(date)
    if grain == "semester":
        half = F.when(F.month(date) <= 6, F.lit(1)).otherwise(F.lit(7))
        return F.make_date(F.year(date), half, F.lit(1))
    return F.trunc(date, {"week": "week", "month": "month", "quarter": "quarter", "year": "year"}[grain])


def period_label(start, grain):
    """Label of the period that starts on `start` (a date column)."""
    year = F.date_format(start, "yyyy")
    if grain == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if grain == "week":
        # A week starts on Monday and belongs to the year of its Thursday.
        number = F.lpad(F.weekofyear(start).cast("string"), 2, "0")
        return F.concat(F.date_format(F.date_add(start, 3), "yyyy"), F.lit("-W"), number)
    if grain == "month":
        return F.date_format(start, "yyyy-MM")
    if grain == "quarter":
        return F.concat(year, F.lit("-Q"), F.quarter(start).cast("string"))
    if grain == "semester":
        return F.concat(year, F.lit("-S"), F.when(F.month(start) <= 6, "1").otherwise("2"))
    return year


_LABELS = {
    "day": r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)",
    "week": r"(?P<y>\d{4})-W(?P<w>\d\d)",
    "month": r"(?P<y>\d{4})-(?P<m>\d\d)",
    "quarter": r"(?P<y>\d{4})-Q(?P<q>[1-4])",
    "semester": r"(?P<y>\d{4})-S(?P<s>[12])",
    "year": r"(?P<y>\d{4})",
}


def _first_of_month(year, month):
    return datetime.date(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)


def period_bounds(label, grain):
    """First day of the labelled period, and first day after it."""
    found = re.fullmatch(_LABELS[grain], label)
    if not found:
        raise ValueError(f"{label!r} is not a {grain} label")
    part = {name: int(value) for name, value in found.groupdict().items()}
    if grain == "day":
        start = datetime.date(part["y"], part["m"], part["d"])
        return start, start + datetime.timedelta(days=1)
    if grain == "week":
        start = datetime.date.fromisocalendar(part["y"], part["w"], 1)
        return start, start + datetime.timedelta(days=7)
    first, months = {
        "month": lambda: (part["m"], 1),
        "quarter": lambda: (3 * part["q"] - 2, 3),
        "semester": lambda: (6 * part["s"] - 5, 6),
        "year": lambda: (1, 12),
    }[grain]()
    return _first_of_month(part["y"], first), _first_of_month(part["y"], first + months)
