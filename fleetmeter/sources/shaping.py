"""Putting the two record sources into one fact, and taking them apart."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import COST_SOURCE, HOUR_SOURCE


def union_sources(hours, costs):
    """One fact from both record kinds; a column one side lacks is NULL there."""
    return hours.withColumn("source", F.lit(HOUR_SOURCE)).unionByName(
        costs.withColumn("source", F.lit(COST_SOURCE)), allowMissingColumns=True
    )


def source_rows(fact, source):
    """Rows of one source. Keep the fact partitioned by `source` to prune the scan."""
    return fact.where(F.col("source") == source)


def hour_rows(fact):
    return source_rows(fact, HOUR_SOURCE)


def cost_rows(fact):
    return source_rows(fact, COST_SOURCE)
