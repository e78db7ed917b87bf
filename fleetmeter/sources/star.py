"""The fact, built from order lines.

The only module that knows the star schema `lineitem, supplier, nation, part`:
a supplier is an asset, its nation the asset's category, an order line a meter
reading, a consumption of a part, or both. See FIXTURES.md §2.
"""

from pyspark.sql import functions as F

from fleetmeter.sources.shaping import union_sources

#: A product whose name is left out, so that lines without a product name occur.
UNNAMED_PRODUCT = "hot gear"


# Columns read from each table. A stated schema spares the look into the files that
# inferring one costs, which is a job per table.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string",
}


def _table(spark, folder, name):
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def on_assets(spark, folder, lines):
    """Order lines with the columns of their asset.

    Suppliers are joined first and nations second: the size Spark estimates for a
    join is a product, so a pre-joined pair of small tables would look too large
    to broadcast.
    """
    supplier = _table(spark, folder, "supplier")
    nation = _table(spark, folder, "nation")
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .withColumns({
            "asset_code": F.col("s_name"),
            "asset_name": F.concat(F.lit("Unit "), F.col("s_suppkey").cast("string")),
            "asset_category": F.when(F.col("s_nationkey") != 0, F.col("n_name")),
        })
    )


def products(spark, folder):
    """Every part with its product: parts of one name are one product, by the least key."""
    part = _table(spark, folder, "part")
    least = part.groupBy("p_name").agg(F.min("p_partkey").alias("product_id"))
    named = F.when(F.col("p_name") != UNNAMED_PRODUCT, F.col("p_name"))
    return part.join(least, "p_name").select("p_partkey", "product_id", named.alias("product_name"))


def _days():
    return F.date_diff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))


def hour_records(spark, folder):
    """A reading of every line. Those of even lines are a day late, so that service
    days without a reading occur."""
    line = _table(spark, folder, "lineitem")
    number = F.col("l_linenumber")
    reset = F.when((number == 7) & (F.col("l_suppkey") % 5 == 0), "true").when(number < 7, "false")
    late = F.when(number % 2 == 0, 1).otherwise(0)
    return on_assets(spark, folder, line.withColumn("late", late)).select(
        "asset_category",
        "asset_code",
        "asset_name",
        F.expr("l_shipdate + make_dt_interval(late, l_linenumber)").alias("date"),
        (_days() * 10 + number).cast("double").alias("total_hour_meter"),
        F.col("l_quantity").alias("hour_meter_per_date"),
        reset.alias("reset_hm"),
    )


def consumption_records(spark, folder):
    """A consumption of every line. Those of suppliers ending in 0 name no product and
    no consumption number, so that assets without products occur."""
    line = _table(spark, folder, "lineitem")
    order = F.col("l_orderkey")
    known = F.col("l_suppkey") % 10 != 0
    meter = F.when(F.col("l_linenumber") != 6, (_days() * 10).cast("double"))
    named = line.join(products(spark, folder), F.col("l_partkey") == F.col("p_partkey"), "left")
    return on_assets(spark, folder, named).select(
        "asset_category",
        "asset_code",
        "asset_name",
        F.col("l_shipdate").alias("date"),
        F.when(known, F.col("product_id")).alias("product_id"),
        "product_name",
        F.col("l_quantity").alias("product_bought_qty"),
        F.col("l_extendedprice").alias("total_price"),
        F.when(known, order).alias("consume_id_good_consume"),
        F.when(order % 11 != 0, order).alias("consume_id_assignment"),
        F.col("l_shipdate").alias("due_date"),
        meter.alias("fix_hm_record"),
    )


def star_fact(spark, folder):
    """One wide fact that serves both schemas."""
    return union_sources(hour_records(spark, folder), consumption_records(spark, folder))
