"""Explicit schemas of the two facts, and the key lists the operators share."""

from pyspark.sql import types as T

TREND_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("asset_category", T.StringType()),
    T.StructField("asset_code", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("total_price", T.DoubleType()),
    T.StructField("hour_meter_per_date", T.DoubleType()),
    T.StructField("reset_hm", T.StringType()),
])

MAINTENANCE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("asset_category", T.StringType()),
    T.StructField("asset_code", T.StringType()),
    T.StructField("total_hour_meter", T.DoubleType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("asset_name", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("product_bought_qty", T.DoubleType()),
    T.StructField("total_price", T.DoubleType()),
    T.StructField("consume_id_good_consume", T.LongType()),
    T.StructField("consume_id_assignment", T.LongType()),
    T.StructField("due_date", T.TimestampNTZType()),
    T.StructField("fix_hm_record", T.DoubleType()),
])

ASSET = ["asset_category", "asset_code"]

REPORT_COLUMNS = [
    "asset_category", "asset_code", "asset_name", "product_name", "status",
    "service_count", "latest_product_maintained_at", "maintained_hour_meter",
    "latest_asset_used_at", "latest_used_hour_meter", "avg_service",
    "hours_after_maintained",
]
