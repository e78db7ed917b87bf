"""Every operator as a query over the given tables: name -> f(spark, folder)."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import BRANDS
from fleetmeter.functions.dates import parse_timestamp, parse_timestamp_lenient
from fleetmeter.functions.numbers import number_or_zero, total_price
from fleetmeter.functions.text import grouped_text, number_text, price_text
from fleetmeter.operators import (
    distribution, kpi, maintenance, options, predicates, ranking, subcategory, trend,
)
from fleetmeter.plans import service_status
from fleetmeter.plans.service_status import ServiceHistory
from fleetmeter.schema import MAINTENANCE_SCHEMA, TREND_SCHEMA
from fleetmeter.sources import readers, shaping
from fleetmeter.sources.staging import files_version, staged, staged_alone, staging_folder, staging_path
from fleetmeter.sources.star import TABLES, consumption_records, hour_records, star_fact

CATEGORIES = ["NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"]
CATEGORIES_AND_NULL = [*CATEGORIES, None]
CODES = ["Supplier#000000001", "Supplier#000000003", "Supplier#000000005"]
PRODUCTS = ["red widget", "blue bolt", None]
FIRST_DAY, LAST_DAY = "1997-03-01", "1998-04-30"
AS_OF = "1999-06-30 12:00:00"
PERIODS = ("1997-03", "1998-04")
DEEP_PAGE = 150
LARGE_FACTORS = [-1e17, -1e22, 1e26]
PAGE_LAST = {
    "service_number": 100, "asset_category": "NATION_3", "asset_code": "Supplier#000000003",
    "asset_name": "Unit 3", "product_name": "red widget", "service_count": 1,
}
LISTED_COLUMNS = ["source", "asset_code", "date", "product_id", "product_name", "total_price"]

QUERIES = {}


def query(function):
    """Registers f(fact) under its own name."""
    QUERIES[function.__name__] = lambda spark, folder: function(star_fact(spark, folder))
    return function


def table_query(function):
    """Registers f(spark, folder) under its own name."""
    QUERIES[function.__name__] = function
    return function


_FACTS = {}


def _maintenance_fact(spark, folder):
    """The maintenance fact as a table: seven branches of the history read it.

    Written once for each session and state of the tables' files; later queries read it again.
    """
    version = files_version(spark, [f"{folder}/{name}.parquet" for name in TABLES])
    key = (spark.sparkContext.applicationId, staging_folder(spark), version)
    if key not in _FACTS:
        fact = readers.conform(star_fact(spark, folder), MAINTENANCE_SCHEMA)
        _FACTS[key] = staged(fact, "fact", by=["source"], folders=2)
    return _FACTS[key]


def history_query(function):
    """Registers f(history) under its own name."""
    QUERIES[function.__name__] = lambda spark, folder: function(
        ServiceHistory(_maintenance_fact(spark, folder))
    )
    return function


# --- sources ---------------------------------------------------------------------


@query
def scan_trend_fact(fact):
    return readers.conform(fact.select(*TREND_SCHEMA.names), TREND_SCHEMA, keep_extra=True)


@query
def scan_maintenance_fact(fact):
    return readers.conform(fact, MAINTENANCE_SCHEMA)


@query
def sql_text(fact):
    text = "SELECT source, asset_category, count(*) AS entries FROM {fact} GROUP BY source, asset_category"
    return readers.run_query(fact.sparkSession, text, fact=fact)


@query
def scan_csv_subset(fact):
    """The fact as CSV files, read back with a column subset."""
    spark = fact.sparkSession
    path = staging_path(spark, "csv")
    readers.conform(fact, MAINTENANCE_SCHEMA).write.option("header", True).csv(path)
    return readers.read_csv_subset(spark, path, LISTED_COLUMNS)


@query
def split_by_source(fact):
    return shaping.hour_rows(fact).select("asset_code", "date", "hour_meter_per_date", "reset_hm")


@query
def split_by_source_cost(fact):
    return shaping.cost_rows(fact).select("asset_code", "date", "product_name", "total_price")


@table_query
def union_sources(spark, folder):
    return shaping.union_sources(
        hour_records(spark, folder), consumption_records(spark, folder)
    ).select("source", "asset_category", "asset_code", "date", "product_name", "total_price",
             "total_hour_meter", "consume_id_assignment")


# --- selections ------------------------------------------------------------------


@query
def fill_unknown_category(fact):
    filled = maintenance.fill_category(fact)
    return filled.groupBy("source", "asset_category").agg(F.count("*").alias("entries"))


@query
def coerce_numeric(fact):
    text = F.when(F.col("product_name").isNull(), "n/a").otherwise(
        F.rint("total_price").cast("long").cast("string")
    )
    marked = fact.withColumn("price_as_text", text)
    return marked.select(
        "source", "asset_code", "date", number_or_zero("price_as_text").alias("price")
    )


@query
def filter_by_category(fact):
    rows = fact.where(predicates.is_member("asset_category", CATEGORIES_AND_NULL))
    return rows.select("source", "asset_category", "asset_code", "date", "product_name")


@query
def filter_by_asset(fact):
    rows = fact.where(predicates.is_member("asset_code", CODES))
    return rows.select("source", "asset_category", "asset_code", "date", "product_name")


@query
def filter_by_table(fact):
    """Assets that ever used one product, as a selection held in a table."""
    users = fact.where(F.col("product_name") == PRODUCTS[0]).select("asset_code").distinct()
    return predicates.in_table(fact, "asset_code", users).select("source", "asset_code", "date")


@query
def filter_product_on_cost_rows(fact):
    rows = fact.where(predicates.product_on_cost_rows(PRODUCTS))
    return rows.select("source", "asset_code", "date", "product_name", "total_price")


@query
def filter_date_closed(fact):
    rows = fact.where(predicates.within_days("date", FIRST_DAY, LAST_DAY))
    return rows.select("source", "asset_code", "date")


@query
def filter_date_open(fact):
    rows = fact.where(predicates.since_day("date", FIRST_DAY, AS_OF))
    return rows.select("source", "asset_code", "date")


@query
def filter_empty_selection(fact):
    return trend.select_rows(fact, "asset", chosen=[]).select("source", "asset_code", "date")


@query
def selection_sorted(fact):
    rows = trend.select_rows(
        fact, "category", CATEGORIES, PRODUCTS, [FIRST_DAY, LAST_DAY]
    )
    return trend.sorted_selection(rows, "category").select(
        "source", "asset_category", "asset_code", "date", "product_name"
    )


@table_query
def parse_dates_lenient(spark, folder):
    rows = consumption_records(spark, folder)
    text = F.when(F.col("consume_id_assignment").isNull(), "not due").otherwise(
        F.date_format("due_date", "yyyy-MM-dd HH:mm:ss")
    )
    marked = rows.select("asset_code", "consume_id_good_consume", text.alias("due_text"))
    return marked.withColumn("due_date", parse_timestamp_lenient("due_text"))


@table_query
def parse_dates_strict(spark, folder):
    rows = consumption_records(spark, folder).where(F.col("due_date").isNotNull())
    text = F.date_format("due_date", "yyyy-MM-dd HH:mm:ss")
    marked = rows.select("asset_code", "consume_id_good_consume", text.alias("due_text"))
    return marked.withColumn("due_date", parse_timestamp("due_text"))


# --- options ---------------------------------------------------------------------


@query
def options_category(fact):
    return options.category_options(fact)


@query
def options_asset(fact):
    return options.asset_options(fact, CATEGORIES_AND_NULL)


@query
def options_product(fact):
    return options.product_options(fact, CODES)


@query
def default_selection(fact):
    return options.default_selection(fact, "asset")


@query
def default_selection_by_category(fact):
    return options.default_selection(fact, "category")


@query
def date_bounds(fact):
    return options.date_bounds(fact, predicates.is_member("asset_category", CATEGORIES_AND_NULL))


@query
def date_bounds_asset(fact):
    return options.date_bounds(fact, predicates.is_member("asset_code", CODES))


# --- headline counts and distribution --------------------------------------------


@query
def kpi_categories(fact):
    return kpi.category_counts(fact, CATEGORIES_AND_NULL)


@query
def kpi_assets(fact):
    return kpi.asset_counts(fact, CATEGORIES_AND_NULL)


@query
def category_distribution(fact):
    return distribution.category_distribution(fact)


@query
def distribution_page_cost(fact):
    return distribution.cost_page(fact, number=1)


@query
def distribution_page_hours(fact):
    return distribution.hours_page(fact, number=0)


# --- trend -----------------------------------------------------------------------


def _trend(entity, grain):
    QUERIES[f"trend_{entity}_{grain}"] = lambda spark, folder: trend.trend(
        star_fact(spark, folder), entity, grain
    )


for _entity in trend.ENTITIES:
    for _grain in ["day", "week", "month", "quarter", "semester", "year"]:
        _trend(_entity, _grain)


def _summary_queries():
    """Trends and rollups out of a written day summary instead of the fact."""
    def register(name, function):
        QUERIES[name] = lambda spark, folder: function(
            staged(trend.day_summary(star_fact(spark, folder)), "day-summary"))

    for entity, grain in [("asset", "day"), ("asset", "week"), ("category", "day"), ("category", "quarter"), ("category", "year")]:
        register(f"summary_trend_{entity}_{grain}", lambda rows, e=entity, g=grain: trend.trend(rows, e, g))
    register("summary_cost_line", lambda rows: trend.cost_line(rows, "category", "week"))
    register("summary_hours_in_periods", lambda rows: trend.hours_in_periods(rows, "asset", "month", PERIODS))
    register("summary_cost_vs_hours", lambda rows: trend.cost_versus_hours(rows, "category", "month"))


_summary_queries()


@query
def trend_asset_selected(fact):
    """All filters of the day view at once."""
    rows = trend.select_rows(fact, "asset", CODES, PRODUCTS, [FIRST_DAY], AS_OF)
    return trend.trend(rows, "asset", "day")


@query
def cost_line_asset(fact):
    return trend.cost_line(fact, "asset", "month")


@query
def cost_line_category(fact):
    return trend.cost_line(fact, "category", "week")


@query
def trend_point(fact):
    return trend.cost_at(fact, "asset", "month", PERIODS[0])


@query
def hours_in_period_range(fact):
    return trend.hours_in_periods(fact, "asset", "month", PERIODS)


@query
def hours_in_day_range(fact):
    return trend.hours_in_periods(fact, "category", "day", (FIRST_DAY, LAST_DAY))


@query
def cost_tooltip_grain(fact):
    return trend.cost_tooltip(fact, "asset", "day")


@query
def hours_bar(fact):
    return trend.hour_bars(fact, "asset", "quarter")


@query
def cost_vs_hours(fact):
    return trend.cost_versus_hours(fact, "category", "month")


@query
def cost_vs_hours_day(fact):
    return trend.cost_versus_hours(fact, "asset", "day")


@query
def reset_events(fact):
    return trend.reset_events(fact)


# --- text ------------------------------------------------------------------------


def _amounts(fact):
    """Total price per asset in steps of 125, at sizes that reach every scale."""
    steps = F.floor(F.col("total_price") / 125000) * 125
    totals = shaping.cost_rows(fact).groupBy("asset_code").agg(total_price().alias("total_price"))
    sizes = F.array(*[F.floor(steps / 1000), steps, *[steps * 10 ** n for n in (3, 5, 8)]])
    return totals.select(
        "asset_code", F.posexplode(sizes).alias("size", "whole")
    ).select("asset_code", "size", F.col("whole").cast("double").alias("amount"))


@query
def format_price(fact):
    return _amounts(fact).withColumn("shown", price_text(F.col("amount")))


@query
def format_number(fact):
    return _amounts(fact).withColumn("shown", number_text(F.col("amount")))


@query
def format_large(fact):
    """Amounts beyond 1e19, either side of zero."""
    amounts = _amounts(fact).where("size = 1 AND amount > 0")
    sizes = F.array(*[F.col("amount") * F.lit(factor) for factor in LARGE_FACTORS])
    large = amounts.select("asset_code", F.explode(sizes).alias("amount"))
    return large.withColumns({"price": price_text(F.col("amount")), "number": number_text(F.col("amount"))})


@query
def format_grouped(fact):
    line = trend.cost_line(fact, "category", "quarter")
    return line.withColumn("shown", grouped_text(F.col("total_price")))


# --- service history -------------------------------------------------------------


@query
def hour_readings(fact):
    return maintenance.hour_readings(fact)


@query
def consumption_agg(fact):
    return maintenance.consumption(shaping.cost_rows(fact))


@query
def distinct_service_events(fact):
    return maintenance.service_events(shaping.cost_rows(fact))


@query
def join_consume_assignment(fact):
    return maintenance.consumption_services(shaping.cost_rows(fact))


@query
def service_events_matched(fact):
    read = maintenance.reading_days(maintenance.hour_readings(fact))
    return maintenance.matched_services(shaping.cost_rows(fact), staged(read, "days"))


@query
def latest_service(fact):
    return maintenance.latest_services(fact)


@query
def latest_reading(fact):
    return maintenance.latest_readings(fact)


@history_query
def service_interval(history):
    return history.service_intervals()


@history_query
def avg_service_interval(history):
    return history.mean_intervals()


@history_query
def join_latest_reading(history):
    return history.with_latest_reading()


@history_query
def join_latest_service(history):
    return history.with_latest_service()


@history_query
def assets_without_products(history):
    return history.assets_without_products()


@history_query
def status_report(history):
    return history.report()


@history_query
def status_filtered(history):
    return service_status.filtered(history.report(), categories=CATEGORIES)


@history_query
def status_filtered_by_code(history):
    return service_status.filtered(history.report(), codes=CODES)


@history_query
def status_filtered_by_both(history):
    return service_status.filtered(history.report(), categories=CATEGORIES, codes=CODES)


@history_query
def status_detail(history):
    return service_status.detail(history.report(), ["Needed service", "Incoming Service"])


@history_query
def report_options_category(history):
    return options.report_options(history.report(), "asset_category", {})


@history_query
def report_options_asset(history):
    return options.report_options(history.report(), "asset_code", {"asset_category": CATEGORIES})


@history_query
def needed_service_count(history):
    return ranking.needed_service_counts(history.report())


@history_query
def top10_needed_service(history):
    return ranking.top_needed_service(history.report())


@history_query
def status_page(history):
    return service_status.detail_page(history, number=1)


@history_query
def status_page_after(history):
    """The page after the service number and asset of PAGE_LAST."""
    return service_status.detail_page_after(history, PAGE_LAST)


@history_query
def status_page_deep(history):
    """A page far down, by its number."""
    return service_status.DetailPages(history).page(DEEP_PAGE)


@history_query
def status_page_count(history):
    return service_status.detail_page_count(history)


# --- product names ---------------------------------------------------------------


def _written_names(spark, folder):
    """Part names written out in full: brand words, codes with digits, signs."""
    brand = F.element_at(
        F.array(*[F.lit(word) for word in BRANDS]),
        (F.col("p_partkey") % len(BRANDS) + 1).cast("int"),
    )
    part = spark.read.parquet(f"{folder}/part.parquet")
    kinds = (
        F.when(F.col("p_size") > 40, F.concat(F.initcap(brand), F.lit(" "), F.col("p_size"), F.lit("W40")))
        .when(F.col("p_size") > 30, F.concat(F.split("p_name", " ")[0], F.lit(" ("), brand, F.lit(")")))
        .otherwise(F.concat_ws(" ", F.upper(brand), "p_brand", "p_name", F.lit("(asli)")))
    )
    return part.select("p_partkey", kinds.alias("product_name"))


@table_query
def clean_product_name(spark, folder):
    return subcategory.product_names(_written_names(spark, folder))


@table_query
def split_by_word_count(spark, folder):
    names = subcategory.product_names(_written_names(spark, folder))

    def kind(rows, label):
        return rows.select(F.lit(label).alias("kind"), subcategory.NAME, "rows")

    return kind(subcategory.one_word(names), "one word").unionByName(
        kind(subcategory.several_words(names), "several words")
    )


@query
def tfidf_terms(fact):
    names = subcategory.several_words(subcategory.product_names(shaping.cost_rows(fact)))
    weights = subcategory.term_weights(names)
    return weights.withColumn("weight", F.round("weight", 9))


def _subcategories(fact):
    return subcategory.subcategories(shaping.cost_rows(fact))


def _history_by_subcategory(fact):
    mapping = staged_alone(fact.sparkSession, "subcategories", lambda: _subcategories(fact))
    costs = subcategory.with_subcategory(shaping.cost_rows(fact), mapping)
    return ServiceHistory(fact, costs, ("product_subcategory",))


@query
def product_subcategory(fact):
    return _subcategories(fact)


@table_query
def status_report_subcategory(spark, folder):
    return _history_by_subcategory(_maintenance_fact(spark, folder)).report()


@table_query
def status_filtered_subcategory(spark, folder):
    fact = _maintenance_fact(spark, folder)
    report = staged_alone(spark, "report", lambda: _history_by_subcategory(fact).report())
    chosen = subcategory.subcategory_options(report, CATEGORIES[:1])
    by_asset = service_status.filtered(report, categories=CATEGORIES)
    return predicates.in_table(by_asset, "product_subcategory", chosen)
