"""Headline counts."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import COST_SOURCE, HOUR_SOURCE
from fleetmeter.operators.predicates import is_member


def _seen_in(fact, column, categories):
    """One row per value of `column`: does it have costs, does it have hours.

    Reducing to values first keeps the distinct counts to one shuffle of one row
    per value, where several `countDistinct` would multiply the input.
    """
    return (
        fact.where(is_member("asset_category", categories))
        .groupBy(column)
        .agg(
            F.bool_or(F.col("source") == COST_SOURCE).alias("has_cost"),
            F.bool_or(F.col("source") == HOUR_SOURCE).alias("has_hours"),
        )
    )


def category_counts(fact, categories):
    """Categories chosen, with cost, with hours. NULL is not counted as a category."""
    named = F.col("asset_category").isNotNull()
    return _seen_in(fact, "asset_category", categories).agg(
        F.lit(len(set(categories))).cast("long").alias("total_categories"),
        F.count_if(named & F.col("has_cost")).alias("categories_maintained"),
        F.count_if(named & F.col("has_hours")).alias("categories_used"),
    )


def asset_counts(fact, categories):
    """Assets in the categories (NULL counts as one), with cost, with hours."""
    named = F.col("asset_code").isNotNull()
    return _seen_in(fact, "asset_code", categories).agg(
        F.count("*").alias("total_assets"),
        F.count_if(named & F.col("has_cost")).alias("assets_maintained"),
        F.count_if(named & F.col("has_hours")).alias("assets_used"),
    )
