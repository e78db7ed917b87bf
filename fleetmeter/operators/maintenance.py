"""Readings, consumption and service events, and how they meet.

A service (one consumption row and one due day) is kept as one row that counts
the meter values recorded for it and the readings taken that day. Every pair of
them is one row of the service history; the counts stand for the pairs, so a busy
day or a busy service number never multiplies rows.
"""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import UNKNOWN_CATEGORY
from fleetmeter.functions.dates import day_of
from fleetmeter.functions.numbers import total_or_zero, total_price
from fleetmeter.operators.predicates import complete
from fleetmeter.schema import ASSET
from fleetmeter.sources.shaping import hour_rows
from fleetmeter.sources.staging import staged


def fill_category(rows):
    """NULL category under its own name, so that it joins and groups."""
    return rows.na.fill(UNKNOWN_CATEGORY, subset=["asset_category"])


def line_keys(extra=()):
    """A product line: one product fitted to one asset.

    Every join, window and group by line takes the keys in this order, so that
    their partitionings agree; the number comes first because sorts compare it
    faster than text.
    """
    return ["product_id", "asset_code", *extra, "asset_category", "asset_name"]


def consumption_keys(extra=()):
    return [*line_keys(extra), "product_name", "date", "consume_id_good_consume"]


def hour_readings(fact):
    """Highest reading per asset and moment; rows without a key are left out."""
    rows = fill_category(hour_rows(fact)).withColumnRenamed("date", "asset_used_at")
    keys = [*ASSET, "asset_used_at"]
    return complete(rows, keys).groupBy(*keys).agg(
        F.max("total_hour_meter").alias("hour_meter")
    )


def reading_days(readings):
    """Days on which an asset was read, with the number of readings."""
    return readings.groupBy(*ASSET, day_of("asset_used_at").alias("due_day")).agg(
        F.count("*").alias("readings")
    )


def latest_readings(fact):
    """Latest moment and highest meter per asset; two maxima, not one row."""
    rows = complete(fill_category(hour_rows(fact)), [*ASSET, "date"])
    return rows.groupBy(*ASSET).agg(
        F.max("date").alias("latest_asset_used_at"),
        F.max("total_hour_meter").alias("latest_used_hour_meter"),
    )


def named_consumption(costs, extra=()):
    """Cost rows that have every consumption key."""
    return complete(fill_category(costs), consumption_keys(extra))


def consumption(costs, extra=()):
    """Quantity and price per consumption."""
    return named_consumption(costs, extra).groupBy(*consumption_keys(extra)).agg(
        total_or_zero("product_bought_qty").alias("product_bought_qty"),
        total_price().alias("total_price"),
    )


def service_events(costs):
    """Distinct service records. A NULL service number matches nothing."""
    return costs.select("consume_id_assignment", "due_date", "fix_hm_record").distinct()


def service_days(events):
    """Service records per service number and due day.

    `events` counts the records, `metered` those with a meter value, and the
    lowest and highest value stand for the values in between: within one day they
    are passed in ascending order, records without a value last.
    """
    known = events.where(F.col("consume_id_assignment").isNotNull())
    return known.groupBy("consume_id_assignment", day_of("due_date").alias("due_day")).agg(
        F.count("*").alias("events"),
        F.count("fix_hm_record").alias("metered"),
        F.min("fix_hm_record").alias("lowest_meter"),
        F.max("fix_hm_record").alias("highest_meter"),
    )


def consumption_services(costs, extra=(), how="left", read=None):
    """Consumption with the days its service number was due; `left` keeps the rest.

    With `read`, the reading days, only assets that were ever read and days on which
    any was take part: a number that many consumptions and many days share makes a
    row for each two of them.
    """
    used = consumption(costs, extra).select(*consumption_keys(extra))
    days = service_days(service_events(costs))
    if read is not None:
        used = used.join(read.select(*ASSET).distinct(), ASSET, "left_semi")
        days = days.join(read.select("due_day").distinct(), "due_day", "left_semi")
    same = used["consume_id_good_consume"] == days["consume_id_assignment"]
    return used.join(days, same, how)


#: Due days of a service number up to which each of its assets is held against each of them.
FEW_DAYS = 32


def busy_numbers(days):
    """Service numbers of more than FEW_DAYS due days, with their number of days."""
    sizes = days.groupBy(F.col("consume_id_assignment").alias("number")).agg(F.count("*").alias("due_days"))
    return sizes.where(F.col("due_days") > FEW_DAYS)


def pairs_to_serve(used, busy, read, asset=ASSET):
    """(number, asset, due_days, read_days): each asset that has a busy number, once, and was ever read."""
    asked = used.select(F.col("consume_id_good_consume").alias("number"), *asset).join(busy, "number").distinct()
    known = read.groupBy(*asset).agg(F.count("*").alias("read_days"))
    return asked.join(known, asset)


def _due(days):
    return days.withColumnRenamed("consume_id_assignment", "number")


def days_to_try(pairs, days, read, asset=ASSET):
    """Two sets of (number, asset, day) that hold every day an asset of `pairs` may have been served.

    The number's due days must meet the asset's reading days. For each pair only the
    shorter of the two lists is gone through: so a number shared by all assets costs
    their reading days, and an asset read every day costs its numbers' due days. The
    sum of the shorter lists is the least bound that holds for any three such tables.
    """
    few_due = F.col("due_days") <= F.col("read_days")
    return pairs.where(few_due).join(_due(days), "number"), pairs.where(~few_due).join(read, asset)


#: What a day of service is known by.
_SERVED = ["number", "asset", "due_day", "events", "metered", "highest_meter", "readings"]


def _served(used, days, read):
    """Days on which an asset was served: a number it used was due and it was read.

    All three tables name an asset by its `asset` number.
    """
    asked = staged(used.select(F.col("consume_id_good_consume").alias("number"), "asset").distinct(), "asked")
    busy = staged(busy_numbers(days), "busy")
    if busy.isEmpty():
        return asked.join(_due(days), "number").join(read, ["asset", "due_day"]).select(*_SERVED)
    shared = asked.join(busy, "number", "left_semi").withColumnRenamed("number", "consume_id_good_consume")
    pairs = staged(pairs_to_serve(shared, busy, read, ["asset"]), "pairs")
    by_number, by_asset = days_to_try(pairs, days, read, ["asset"])
    own = asked.join(busy, "number", "left_anti").join(_due(days), "number")
    tried = own.select("number", "asset", *days.columns[1:]).unionByName(
        by_number.select("number", "asset", *days.columns[1:]))
    return tried.join(read, ["asset", "due_day"]).select(*_SERVED).unionByName(
        by_asset.join(_due(days), ["number", "due_day"]).select(*_SERVED))


def matched_services(costs, read, extra=()):
    """Services due on a day on which the asset was read, of a written table of reading days.

    Due days of a service number meet reading days by the assets that used the number,
    each once and under a number of its own, so the many rows in between are narrow;
    consumptions meet only the days their asset was served. An asset's services are never
    paired with all its readings, nor a number of many days and many assets as a whole
    (see `days_to_try`).

    `pairs` counts the (record, reading) pairs a row stands for, `metered_pairs`
    those with a meter value. The service after this one is measured from
    `closing_meter`, which is NULL when a record without a value comes last.
    """
    assets = read.select(*ASSET).distinct().withColumn("asset", F.monotonically_increasing_id())
    assets = staged(assets, "assets")
    due = read.select("due_day").distinct()
    read = staged(read.join(assets, ASSET).select("asset", "due_day", "readings"), "read")
    used = consumption(costs, extra).select(*consumption_keys(extra))
    used = staged(used.join(assets, ASSET), "used")
    days = service_days(service_events(costs)).join(due, "due_day", "left_semi")
    days = staged(days.select("consume_id_assignment", "due_day", "events", "metered", "highest_meter"), "due")
    served = staged(_served(used, days, read), "served").withColumnRenamed("asset", "served_asset")
    closing = F.when(F.col("metered") == F.col("events"), F.col("highest_meter"))
    same = [used["consume_id_good_consume"] == served["number"], used["asset"] == served["served_asset"]]
    return used.join(served, same).select(
        *consumption_keys(extra),
        "due_day",
        "highest_meter",
        closing.alias("closing_meter"),
        (F.col("events") * F.col("readings")).alias("pairs"),
        (F.col("metered") * F.col("readings")).alias("metered_pairs"),
    )


def lowest_by_number(costs):
    """Lowest meter value per service number."""
    numbered = complete(costs, ["consume_id_assignment", "fix_hm_record"])
    return numbered.groupBy("consume_id_assignment").agg(
        F.min("fix_hm_record").alias("lowest_meter")
    )


def lowest_meters(costs, lowest, extra=()):
    """Lowest meter value per product line over all its services, read or not.

    `lowest` has one row per service number, so the join adds no rows.
    """
    used = named_consumption(costs, extra).select(*line_keys(extra), "consume_id_good_consume")
    same = used["consume_id_good_consume"] == lowest["consume_id_assignment"]
    return used.join(lowest, same).groupBy(*line_keys(extra)).agg(
        F.min("lowest_meter").alias("lowest_meter")
    )


def latest_services(fact):
    """Latest due moment and highest meter per service number, over all rows."""
    rows = fact.where(F.col("consume_id_assignment").isNotNull())
    return rows.groupBy("consume_id_assignment").agg(
        F.max("due_date").alias("latest_product_maintained_at"),
        F.max("fix_hm_record").alias("maintained_hour_meter"),
    )
