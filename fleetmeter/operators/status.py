"""Service status of every product on every asset."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import GOOD, INCOMING, INCOMING_HOURS, NEEDED, NOT_REGISTERED
from fleetmeter.schema import ASSET, REPORT_COLUMNS

NUMBER = "consume_id_good_consume"


def _keep_all(left, right, same, right_keys, present):
    """Full outer join as left join plus the right rows whose key is not `present`.

    `right` has one row per key. A full outer join holds all rows of one key in
    memory and cannot be split when a key is hot; a left join can. `present` is a
    cheap source of the keys of `left`.
    """
    both = left.join(right, same, "left")
    alone = right.join(present, right_keys, "left_anti")
    return both.unionByName(alone, allowMissingColumns=True)


def assets_without_products(services, latest):
    """Assets that have readings and no service on record."""
    return latest.join(services.select(*ASSET).distinct(), ASSET, "left_anti")


def with_latest_reading(means, services, latest):
    """Latest reading per asset, also of assets without services."""
    return _keep_all(means, latest, ASSET, ASSET, services.select(*ASSET).distinct())


def with_latest_service(means, services, latest):
    """Latest service per service number, also of numbers without a row."""
    present = services.select(F.col(NUMBER).alias("consume_id_assignment")).distinct()
    same = means[NUMBER] == latest["consume_id_assignment"]
    return _keep_all(means, latest, same, ["consume_id_assignment"], present)


def service_status(hours, average, product, used_at):
    """First rule that holds; NULL where none does."""
    return (
        F.when(hours > average, NEEDED)
        .when((hours >= average - INCOMING_HOURS) & (hours <= average), INCOMING)
        .when(hours < average, GOOD)
        .when(product.isNull() & used_at.isNotNull(), NOT_REGISTERED)
    )


def classify(rows):
    hours = F.col("latest_used_hour_meter") - F.col("maintained_hour_meter")
    status = service_status(
        F.col("hours_after_maintained"),
        F.col("avg_service"),
        F.col("product_name"),
        F.col("latest_asset_used_at"),
    )
    return rows.withColumn("hours_after_maintained", hours).withColumn("status", status)


def report_columns(rows, extra=()):
    """The report's columns; a row without any value is dropped."""
    names = [*REPORT_COLUMNS[:3], *extra, *REPORT_COLUMNS[3:]]
    return rows.select(*names).na.drop("all")
