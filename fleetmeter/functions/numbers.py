"""Numbers: exact sums, lenient casts, half-even rounding."""

from pyspark.sql import functions as F

_MILLION = 10 ** 6


_SIZES = (10 ** 6, 1, "0.000001")


def _parts(column):
    """A double as millions, units and millionths; below a millionth it is rounded."""
    value = F.col(column)
    millions = F.floor(value / _MILLION)
    below = value - millions.cast("double") * _MILLION
    units = F.floor(below)
    return millions, units, F.rint((below - units) * _MILLION).cast("long")


def _whole_again(sums):
    return sum(
        (total.cast("decimal(20,0)") * F.expr(f"cast('{size}' as decimal(13,6))") for total, size in zip(sums, _SIZES)),
        start=F.lit(0).cast("decimal(1,0)"),
    )


def exact_sum(column):
    """Sum of doubles as a decimal with six places; NULL where no row has a value.

    A value is taken apart into millions, units and millionths, each added in a long:
    partial sums stay primitive, no order of rows or repeated task can change a total,
    and it may reach 9e24 over 9e12 rows.
    """
    return _whole_again([F.sum(part) for part in _parts(column)])


def part_names(column):
    return [f"{column}_millions", f"{column}_units", f"{column}_millionths"]


def exact_parts(column):
    """The three sums of `exact_sum` as columns, to be written and added up again."""
    return [F.sum(part).alias(name) for part, name in zip(_parts(column), part_names(column))]


def merged_sum(column):
    """`exact_sum` over rows that hold its parts."""
    return _whole_again([F.sum(name) for name in part_names(column)])


def total_price(column="total_price"):
    """Sum of money; a group with no price at all is 0."""
    return total_or_zero(column)


def mean_price(column="total_price"):
    """Mean of money over the rows that have one; NULL where no row has."""
    return F.try_divide(exact_sum(column).cast("double"), F.count(column))


def total_or_zero(column):
    """Sum of amounts, hours or quantities; a group with no value at all is 0."""
    return F.coalesce(exact_sum(column).cast("double"), F.lit(0.0))


def number_or_zero(column):
    """Text or number to double; what is not a number, and NULL, become 0."""
    number = F.col(column).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


def whole(column):
    """Rounded to an integer value, ties to even."""
    return F.bround(column, 0)
