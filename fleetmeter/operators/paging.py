"""Pages of an ordered result."""

from functools import reduce
from math import ceil

from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetmeter.operators.numbering import beginnings, in_order
from fleetmeter.sources.staging import staged


def ascending(*columns):
    return [(column, True) for column in columns]


def _sort(order):
    return [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order]


def page(df, order, size, number=0):
    """Page `number` of `df` under a total order of (column, ascending) pairs.

    A bounded top-k of (number + 1) * size rows, so meant for the first pages; go
    deep with `page_after`, or with a `PageDirectory` where pages are asked for by number.
    """
    return df.orderBy(*_sort(order)).offset(number * size).limit(size)


def page_after(df, order, size, last):
    """The page that follows the row `last`, a mapping of the order columns.

    Costs the same however deep: the rows before are filtered out, not sorted.
    """
    def beyond(column, up):
        value = last[column]
        if value is None:
            return F.lit(False)
        further = F.col(column) > F.lit(value) if up else F.col(column) < F.lit(value)
        return further | F.col(column).isNull()

    later = []
    equal = F.lit(True)
    for column, up in order:
        later.append(equal & beyond(column, up))
        equal = equal & F.col(column).eqNullSafe(F.lit(last[column]))
    return df.where(reduce(lambda a, b: a | b, later)).orderBy(*_sort(order)).limit(size)


class PageDirectory:
    """Pages of an ordered result by number, at one cost however deep.

    The rows are written once in order, in stretches of even size, each in a folder of
    its own; the directory is a row for each stretch: how many rows are before it, and
    how many in it. A page looks up the one or few stretches it lies in and reads those.
    """

    def __init__(self, df, order, stretches=None):
        self.rows = in_order(df, _sort(order), "pages", stretches, apart=True)
        self.directory = staged(beginnings(self.rows).drop("first"), "page-directory")

    def counts(self, size):
        """Total rows and total pages, from the directory."""
        rows = int(self.directory.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        return rows, ceil(rows / size)

    def page(self, size, number=0):
        """Rows of page `number` with `pos`, the place on the page from 1."""
        first, end = number * size, (number + 1) * size
        # At most `size` stretches: each has a row on the page.
        held = self.directory.where((F.col("begins") < end) & (F.col("begins") + F.col("rows") > first)).collect()
        place, on_page = F.lit(None).cast("long"), F.lit(False)
        for stretch in held:
            begins, here = stretch["begins"], F.col("stretch") == stretch["stretch"]
            on_page = on_page | (here & F.col("place").between(first - begins, end - begins - 1))
            place = F.when(here, F.col("place") + (begins - first + 1)).otherwise(place)
        return self.rows.where(on_page).withColumn("pos", place).drop("stretch", "place").orderBy("pos")


def numbered(paged, order):
    """Adds `pos`, the place on the page. Only for a page: it uses one task."""
    place = F.row_number().over(Window.orderBy(*_sort(order)))
    return paged.withColumn("pos", place.cast("long"))


def page_count(df, size):
    """Total rows and total pages."""
    rows = F.count("*")
    return df.agg(rows.alias("total_rows"), F.ceil(rows / size).cast("long").alias("total_pages"))
