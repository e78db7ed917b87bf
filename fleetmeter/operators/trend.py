"""Cost and hours by period, and the rollups drawn from them."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import PERIOD_COLUMNS, RESET_FLAG, RESET_MESSAGE
from fleetmeter.functions.dates import period_bounds, period_label, period_start
from fleetmeter.functions.numbers import (
    exact_parts, exact_sum, merged_sum, part_names, total_or_zero, total_price,
)
from fleetmeter.operators.predicates import in_date_range, is_member, product_on_cost_rows, within_days

ENTITIES = {"asset": "asset_code", "category": "asset_category"}


#: Column of a summary's highest reading of a day.
HIGHEST = "highest_hour_meter_per_date"
AMOUNTS = ("total_price", "hour_meter_per_date")


def day_summary(fact):
    """One row per source, asset, reset flag, product and day, which adds up to any trend.

    Sums are kept in the parts they are added in, so longer periods and whole categories
    have the totals their rows have, to the last digit; a day's hours keep their highest
    reading. Write it once: every function of this module takes it in place of the fact.
    Times of day are gone: a selection may not end inside a day.
    """
    labels = [name for name in PERIOD_COLUMNS.values() if name in fact.columns]
    day = F.date_trunc("day", "date").cast("timestamp_ntz").alias("date")
    return fact.groupBy("source", "asset_category", "asset_code", "reset_hm", "product_name", day, *labels).agg(
        *[part for amount in AMOUNTS for part in exact_parts(amount)],
        F.max("hour_meter_per_date").alias(HIGHEST))


def _is_summary(rows):
    return HIGHEST in rows.columns


def _total(rows, amount):
    """Sum of an amount over rows of the fact or of a summary; 0 where no row has a value."""
    if _is_summary(rows) and part_names(amount)[0] in rows.columns:
        return F.coalesce(merged_sum(amount).cast("double"), F.lit(0.0)).alias(amount)
    return total_or_zero(amount).alias(amount)


def select_rows(fact, entity="asset", chosen=None, products=None, days=None, as_of=None):
    """Rows behind a trend: chosen entities, date range, products of cost rows.

    None means no restriction; an empty list means no rows (for products, no cost
    rows).
    """
    condition = in_date_range("date", days, as_of)
    if chosen is not None:
        condition = condition & is_member(ENTITIES[entity], chosen)
    if products is not None:
        condition = condition & product_on_cost_rows(products)
    return fact.where(condition)


def sorted_selection(rows, entity="asset"):
    """Rows in order of entity and date, for display; no other operator needs it."""
    return rows.orderBy(F.asc_nulls_last(ENTITIES[entity]), F.asc_nulls_last("date"))


def _keys(entity):
    """Group keys before and after the period."""
    before = ["source", "asset_category"] + (["asset_code"] if entity == "asset" else [])
    return before + ["reset_hm"], ["product_name"]


def _group(rows, grain, before, after, aggregates):
    """`rows` grouped by period among other keys, the period shown as its label.

    A label column the fact already carries is used as it is.
    """
    name = PERIOD_COLUMNS[grain]
    if name in rows.columns:
        return rows.groupBy(*before, name, *after).agg(*aggregates)
    start = period_start("date", grain).alias("_start")
    grouped = rows.groupBy(*[F.col(c) for c in before], start, *[F.col(c) for c in after])
    label = period_label(F.col("_start"), grain).alias(name)
    values = grouped.agg(*aggregates)
    skip = {*before, "_start", *after}
    rest = [c for c in values.columns if c not in skip]
    return values.select(*before, label, *after, *rest)


def _hours(rows, grain):
    """A day's hours are its highest reading; longer periods add up."""
    if grain == "day":
        highest = HIGHEST if _is_summary(rows) else "hour_meter_per_date"
        return F.max(highest).alias("hour_meter_per_date")
    return _total(rows, "hour_meter_per_date")


def trend_rows(rows, entity="asset", grain="month"):
    """The trend without its order."""
    before, after = _keys(entity)
    return _group(rows, grain, before, after, [_total(rows, "total_price"), _hours(rows, grain)])


def trend_order(entity, grain):
    before, after = _keys(entity)
    period = PERIOD_COLUMNS[grain]
    if grain == "day":
        columns = [*before, period, *after]
    else:
        first = [ENTITIES[entity], period]
        columns = first + [c for c in [*before, *after] if c not in first]
    return [F.asc_nulls_last(c) for c in columns]


def trend(rows, entity="asset", grain="month"):
    """Total price and hours per source, entity, reset flag, period and product."""
    return trend_rows(rows, entity, grain).orderBy(*trend_order(entity, grain))


def cost_line(rows, entity="asset", grain="month"):
    """Total price per period and entity.

    Straight from the rows: the sum of the trend's sums is the sum of the rows.
    """
    return _group(rows, grain, [], [ENTITIES[entity]], [_total(rows, "total_price")])


def cost_at(rows, entity, grain, label):
    """The cost line at one period, which also limits the rows read."""
    return cost_line(_in_periods(rows, grain, label, label), entity, grain)


def _in_periods(rows, grain, first, last):
    """Rows of the periods from label `first` to `last`, as a range of dates."""
    name = PERIOD_COLUMNS[grain]
    if name in rows.columns:
        return rows.where(F.col(name).between(first, last))
    start, _ = period_bounds(first, grain)
    _, after = period_bounds(last, grain)
    if after <= start:
        return rows.where(F.lit(False))
    return rows.where(within_days("date", start, after.fromordinal(after.toordinal() - 1)))


def hours_in_periods(rows, entity="asset", grain="month", periods=None):
    """Hours per entity over a range of period labels; no range, no rows."""
    if periods is None:
        rows = rows.where(F.lit(False))
    else:
        rows = _in_periods(rows, grain, *periods)
    name = ENTITIES[entity]
    if grain == "day":
        rows = trend_rows(rows, entity, grain)
    return rows.groupBy(name).agg(_total(rows, "hour_meter_per_date").alias("hours"))


def cost_versus_hours(rows, entity="asset", grain="month"):
    """Total price and hours per period and entity, in one pass."""
    if grain == "day":
        period, name = PERIOD_COLUMNS[grain], ENTITIES[entity]
        return trend_rows(rows, entity, grain).groupBy(period, name).agg(
            total_price().alias("total_price"), total_or_zero("hour_meter_per_date").alias("hours")
        )
    values = [_total(rows, "total_price"), _total(rows, "hour_meter_per_date").alias("hours")]
    return _group(rows, grain, [], [ENTITIES[entity]], values)


def _shown(entity, grain):
    codes = ["asset_code"] if entity == "asset" else []
    return [PERIOD_COLUMNS[grain], *codes, "asset_category"]


def cost_tooltip(rows, entity="asset", grain="month"):
    """Price under the pointer: trend rows of equal price share one sum."""
    trend_prices = trend_rows(rows, entity, grain)
    return trend_prices.groupBy(*_shown(entity, grain), "total_price").agg(
        exact_sum("total_price").cast("double").alias("sum_total_price")
    )


def hour_bars(rows, entity="asset", grain="month"):
    """One bar per trend row."""
    return trend_rows(rows, entity, grain).select(*_shown(entity, grain), "hour_meter_per_date")


def reset_events(rows):
    """Days on which an asset's hour meter was set back, with a message."""
    marked = trend_rows(rows, "asset", "day").where(F.col("reset_hm") == RESET_FLAG)
    message = F.concat(F.col("asset_code"), F.lit(RESET_MESSAGE))
    return marked.select(F.col(PERIOD_COLUMNS["day"]).alias("date"), message.alias("annotation"))
