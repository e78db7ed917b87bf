"""Meter hours between services of a product line.

Services of a line are ordered by due day, product name, consumption date and
service number. Each one's interval is its meter value less the previous one's,
or less the line's lowest value where there is no previous value. Further pairs
of the same service add nothing, so its whole interval is its highest value less
the value before it.

A line may hold any share of the rows, so it is never sorted in one task. All
services are sorted together, over as many tasks as there are partitions, and
every task's share is a stretch: it has an even size however rows are spread over
lines, and stretches follow each other in the order of services. Values are passed
on inside a stretch first, then from one stretch of a line to the next.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetmeter.operators.maintenance import line_keys
from fleetmeter.schema import ASSET

NUMBER = "consume_id_good_consume"
IN_LINE = ["due_day", "product_name", "date", NUMBER]


def in_stretches(services, extra=(), stretches=None):
    """Services in order, with the number of their `stretch`.

    The number is only fixed once the result is written: write it before use.
    """
    order = [*line_keys(extra), *IN_LINE]
    if stretches is None:
        ordered = services.repartitionByRange(*order)
    else:
        ordered = services.repartitionByRange(stretches, *order)
    return ordered.withColumn("stretch", F.spark_partition_id())


def _with_previous(services, extra):
    """Closing value of the previous service of the line in the stretch.

    `opens` and `closes` mark the first and the last.
    """
    inside = Window.partitionBy(*line_keys(extra), "stretch").orderBy(*IN_LINE)
    return services.withColumns({
        "opens": F.row_number().over(inside) == 1,
        "closes": F.lead(F.lit(True)).over(inside).isNull(),
        "previous": F.lag("closing_meter").over(inside),
    })


def _from_stretch_before(parts, column, extra):
    """Value of the line's previous stretch; a line has one row per stretch here."""
    return F.lag(column).over(Window.partitionBy(*line_keys(extra)).orderBy("stretch"))


def _or_zero(column):
    return F.coalesce(column, F.lit(0.0))


def line_statistics(services, lowest, extra=()):
    """Mean interval, rounded half to even, number of services and lowest value per line.

    Intervals are summed as hours from the previous value, plus a count of those
    to be taken from the line's lowest value, which is known only at the end.
    """
    keys = line_keys(extra)
    meter = F.col("highest_meter")
    inner = ~F.col("opens") & meter.isNotNull()
    parts = _with_previous(services, extra).groupBy(*keys, "stretch").agg(
        F.sum(F.when(inner, meter - _or_zero("previous"))).alias("hours"),
        F.count_if(inner & F.col("previous").isNull()).alias("from_lowest"),
        F.max(F.when(F.col("opens"), meter)).alias("first_meter"),
        F.max(F.when(F.col("closes"), F.col("closing_meter"))).alias("closing_meter"),
        F.sum("pairs").alias("pairs"),
        F.sum("metered_pairs").alias("metered_pairs"),
    )
    first = F.col("first_meter")
    lines = (
        parts.withColumn("previous", _from_stretch_before(parts, "closing_meter", extra))
        .groupBy(*keys)
        .agg(
            _or_zero(F.sum(_or_zero("hours") + _or_zero(first - _or_zero("previous")))).alias("hours"),
            F.sum(
                F.col("from_lowest")
                + F.when(first.isNotNull() & F.col("previous").isNull(), 1).otherwise(0)
            ).alias("from_lowest"),
            F.sum("pairs").alias("service_count"),
            F.sum("metered_pairs").alias("metered_pairs"),
        )
    )
    total = F.col("hours") - F.col("from_lowest") * _or_zero("lowest_meter")
    mean = F.when(F.col("metered_pairs") > 0, total / F.col("metered_pairs"))
    return lines.join(lowest, keys, "left").select(
        *keys, F.bround(mean, 0).alias("avg_serviced_when"), "service_count", "lowest_meter"
    )


def service_intervals(services, statistics, extra=()):
    """Every service with its interval, its line's mean interval and service count."""
    keys = line_keys(extra)
    linked = _with_previous(services, extra)
    ends = linked.where("closes").select(*keys, "stretch", "closing_meter")
    before = ends.withColumn("before", _from_stretch_before(ends, "closing_meter", extra))
    previous = F.when(F.col("opens"), F.col("before")).otherwise(F.col("previous"))
    return (
        linked.join(before.drop("closing_meter"), [*keys, "stretch"])
        .withColumn("previous", previous)
        .join(statistics, keys)
        .select(
            *keys, "product_name", "date", NUMBER, "due_day",
            (F.col("highest_meter") - F.coalesce("previous", "lowest_meter")).alias("serviced_when"),
            "pairs", "avg_serviced_when", "service_count",
        )
    )


def mean_intervals(services, statistics, extra=()):
    """Mean interval per asset, product name, service count and service number.

    Lines that share a product name are weighted by their pairs.
    """
    mean = F.col("avg_serviced_when")
    weight = F.when(mean.isNotNull(), F.col("pairs"))
    return services.join(statistics, line_keys(extra)).groupBy(
        *ASSET, "asset_name", *extra, "product_name", "service_count", NUMBER
    ).agg(
        F.try_divide(F.sum(weight * mean), F.sum(weight).cast("double")).alias("avg_service")
    )
