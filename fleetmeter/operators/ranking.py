"""Assets ranked by the products that need service."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import NEEDED, TOP_ASSETS
from fleetmeter.operators.paging import numbered, page
from fleetmeter.operators.predicates import complete

KEYS = ["asset_category", "asset_code", "asset_name"]
ORDER = [("count", False), *[(key, True) for key in KEYS]]


def needed_service_counts(report):
    """Products that need service, per asset."""
    return complete(report.where(F.col("status") == NEEDED), KEYS).groupBy(*KEYS).count()


def top_needed_service(report, size=TOP_ASSETS):
    """The assets with most products that need service; ties by asset."""
    return numbered(page(needed_service_counts(report), ORDER, size), ORDER)
