"""Average price and hours per category."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import COST_SOURCE, DISTRIBUTION_PAGE, HOUR_SOURCE
from fleetmeter.functions.numbers import mean_price, whole
from fleetmeter.functions.text import number_text, price_text
from fleetmeter.operators.paging import numbered, page
from fleetmeter.operators.predicates import complete

KEYS = ["source", "asset_category"]
# Highest mean first. The keys make the order total.
ORDER = [("_price", False), ("_hours", False), ("source", True), ("asset_category", True)]


def _means(fact):
    return (
        complete(fact, KEYS)
        .groupBy(*KEYS)
        .agg(
            mean_price().alias("_price"),
            F.avg("hour_meter_per_date").alias("_hours"),
            F.countDistinct("asset_code").alias("distinct_asset_codes"),
        )
    )


def _rounded(means):
    return means.select(
        *KEYS,
        whole("_price").alias("mean_total_price"),
        whole("_hours").alias("mean_hour_meter_per_date"),
        "distinct_asset_codes",
        *[c for c in means.columns if c == "pos"],
    )


def category_distribution(fact):
    """Mean price, mean hours and assets per source and category, highest first.

    Means are rounded to whole numbers after sorting.
    """
    order = [F.desc_nulls_last("_price"), F.desc_nulls_last("_hours"), *KEYS]
    return _rounded(_means(fact).orderBy(*order))


def _page(fact, source, number, text):
    means = _means(fact.where(F.col("source") == source))
    paged = numbered(page(means, ORDER, DISTRIBUTION_PAGE, number), ORDER)
    return _rounded(paged).withColumn(*text)


def cost_page(fact, number=0):
    """One page of categories by average price, with the price as text."""
    text = "price_text", price_text(F.col("mean_total_price"))
    return _page(fact, COST_SOURCE, number, text)


def hours_page(fact, number=0):
    """One page of categories by average hours, with the hours as text."""
    text = "number_text", number_text(F.col("mean_hour_meter_per_date"))
    return _page(fact, HOUR_SOURCE, number, text)
