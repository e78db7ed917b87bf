"""Row selections."""

import datetime
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from fleetmeter.fixed_values import COST_SOURCE, HOUR_SOURCE


def is_member(column, values):
    """Membership where NULL is a value like any other.

    An empty list matches nothing.
    """
    known = [value for value in values if value is not None]
    match = F.col(column).isin(known) if known else F.lit(False)
    if len(known) < len(values):
        match = match | F.col(column).isNull()
    return match


def in_table(df, column, table):
    """Rows whose `column` occurs in the one column of `table`, NULL included.

    For selections too long for a list. Values are joined by plain equality, so that a
    selection too large to broadcast can still reach the scan of `df` as a run-time Bloom
    filter, and rows of NULL do not gather in one task; these come by a branch of their own,
    which asks once whether the selection has a NULL. `df` is read by both branches.
    """
    listed = table.select(F.col(table.columns[0]).alias("_listed"))
    values = df.where(df[column].isNotNull()).join(
        listed.where(F.col("_listed").isNotNull()), df[column] == F.col("_listed"), "left_semi")
    # One row.
    has_null = listed.agg(F.coalesce(F.bool_or(F.col("_listed").isNull()), F.lit(False))).scalar()
    return values.unionByName(df.where(df[column].isNull() & has_null))


def within_days(column, first, last):
    """First day to last day, both whole."""
    after = _day(last) + datetime.timedelta(days=1)
    return (F.col(column) >= _midnight(_day(first))) & (F.col(column) < _midnight(after))


def since_day(column, first, as_of=None):
    """First day up to a moment, by default the time of the call."""
    moment = as_of or datetime.datetime.now()
    return (F.col(column) >= _midnight(_day(first))) & (F.col(column) <= _moment(moment))


def in_date_range(column, days, as_of=None):
    """Two days: closed range. One day: from it up to `as_of`. None: no restriction."""
    days = list(days or [])
    if not days:
        return F.lit(True)
    if len(days) == 1:
        return since_day(column, days[0], as_of)
    return within_days(column, days[0], days[1])


def product_on_cost_rows(products):
    """Chosen products among cost rows; hour rows pass untouched.

    One predicate over one scan, in place of a union of two filtered scans.
    """
    source = F.col("source")
    return (source == HOUR_SOURCE) | ((source == COST_SOURCE) & is_member("product_name", products))


def complete(rows, columns):
    """Rows in which none of the columns is NULL; unlike `na.drop`, this reaches the scan."""
    return rows.where(reduce(and_, [F.col(column).isNotNull() for column in columns]))


def optional(selections):
    """All of the given memberships; an empty selection restricts nothing."""
    condition = F.lit(True)
    for column, values in selections.items():
        if values:
            condition = condition & is_member(column, values)
    return condition


def _day(value):
    if isinstance(value, datetime.datetime):
        return value.date()
    return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(value)


def _midnight(day):
    return _moment(datetime.datetime.combine(day, datetime.time()))


def _moment(value):
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
