"""Values a user can choose from, and the choices made for them."""

from pyspark.sql import functions as F

from fleetmeter.operators.predicates import is_member, optional
from fleetmeter.sources.staging import staged

FIRST_SEEN = "first_date"


def options_by_date(fact, column, condition=None):
    """Distinct values in the order they first occur; ties by value."""
    rows = fact if condition is None else fact.where(condition)
    return (
        rows.groupBy(column)
        .agg(F.min("date").alias(FIRST_SEEN))
        .orderBy(F.asc_nulls_last(FIRST_SEEN), F.asc_nulls_last(column))
    )


def category_options(fact):
    return options_by_date(fact, "asset_category")


def asset_options(fact, categories):
    return options_by_date(fact, "asset_code", is_member("asset_category", categories))


def product_options(fact, codes):
    return options_by_date(fact, "product_name", is_member("asset_code", codes))


def report_options(report, column, selections):
    """Distinct values of a report column, alphabetical, under other selections."""
    return (
        report.where(optional(selections))
        .select(column)
        .distinct()
        .orderBy(F.asc_nulls_last(column))
    )


def date_bounds(fact, condition):
    """First and last day with rows."""
    return fact.where(condition).agg(
        F.min("date").cast("date").alias("first_day"),
        F.max("date").cast("date").alias("last_day"),
    )


def _first(options, column):
    """The first option: one row, so the broadcast below it is bounded."""
    return F.broadcast(options.limit(1).select(F.col(column).alias("_default")))


def default_selection(fact, grouped_by="asset"):
    """The selection before the user makes one, as (level, value) rows.

    The first category by date; by asset its first code, by category all its
    codes; and every product of those codes. The fact is read once, for a small
    table of what occurs together since when, which is written and read from there.
    """
    seen = staged(
        fact.groupBy("asset_category", "asset_code", "product_name").agg(F.min("date").alias("date")),
        "options")
    first_category = _first(category_options(seen), "asset_category")
    in_category = seen.join(
        first_category, seen["asset_category"].eqNullSafe(F.col("_default")), "left_semi"
    )
    if grouped_by == "asset":
        codes = _first(options_by_date(in_category, "asset_code"), "asset_code")
    else:
        codes = in_category.select(F.col("asset_code").alias("_default")).distinct()
    of_codes = seen.join(codes, seen["asset_code"].eqNullSafe(F.col("_default")), "left_semi")
    products = of_codes.select("product_name").distinct()

    def level(rows, name, column):
        return rows.select(F.lit(name).alias("level"), F.col(column).alias("value"))

    return (
        level(first_category, "category", "_default")
        .unionByName(level(codes, "asset", "_default"))
        .unionByName(level(products, "product", "product_name"))
    )
