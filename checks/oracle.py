"""The registered queries in SQL, written out literally.

Page B's service history is spelled here pair by pair, as every consumption with
every record of its service number and every reading of that day; the Spark side
counts the pairs instead.
"""

from checks.queries import (
    AS_OF, CATEGORIES, CODES, DEEP_PAGE, FIRST_DAY, LARGE_FACTORS, LAST_DAY, LISTED_COLUMNS, PAGE_LAST, PERIODS, PRODUCTS,
)
from fleetmeter.fixed_values import BRANDS, STATUSES

ORACLE = {}

FACT = """
WITH asset AS (
  SELECT s_suppkey, s_name AS asset_code, 'Unit ' || s_suppkey AS asset_name,
         CASE WHEN s_nationkey <> 0 THEN n_name END AS asset_category
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
product AS (
  SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS product_id,
         CASE WHEN p_name <> 'hot gear' THEN p_name END AS product_name FROM part),
hm AS (
  SELECT asset_category, asset_code, asset_name,
         l_shipdate + to_days(1 - l_linenumber % 2) + to_hours(l_linenumber) AS date,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 10 + l_linenumber AS DOUBLE)
           AS total_hour_meter,
         l_quantity AS hour_meter_per_date,
         CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN 'true'
              WHEN l_linenumber < 7 THEN 'false' END AS reset_hm
  FROM lineitem JOIN asset ON l_suppkey = s_suppkey),
gc AS (
  SELECT asset_category, asset_code, asset_name, l_shipdate AS date,
         CASE WHEN l_suppkey % 10 <> 0 THEN product_id END AS product_id, product_name,
         l_quantity AS product_bought_qty, l_extendedprice AS total_price,
         CASE WHEN l_suppkey % 10 <> 0 THEN l_orderkey END AS consume_id_good_consume,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey END AS consume_id_assignment,
         l_shipdate AS due_date,
         CASE WHEN l_linenumber <> 6
              THEN CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 10 AS DOUBLE) END
           AS fix_hm_record
  FROM lineitem JOIN asset ON l_suppkey = s_suppkey
  LEFT JOIN product ON l_partkey = p_partkey),
fact AS (
  SELECT 'hm_record' AS source, asset_category, asset_code, asset_name, date,
         total_hour_meter, hour_meter_per_date, reset_hm,
         CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS VARCHAR) AS product_name,
         CAST(NULL AS DOUBLE) AS product_bought_qty, CAST(NULL AS DOUBLE) AS total_price,
         CAST(NULL AS BIGINT) AS consume_id_good_consume,
         CAST(NULL AS BIGINT) AS consume_id_assignment,
         CAST(NULL AS TIMESTAMP) AS due_date, CAST(NULL AS DOUBLE) AS fix_hm_record
  FROM hm
  UNION ALL
  SELECT 'good_consume', asset_category, asset_code, asset_name, date, NULL, NULL, NULL,
         product_id, product_name, product_bought_qty, total_price,
         consume_id_good_consume, consume_id_assignment, due_date, fix_hm_record
  FROM gc)
"""


def over_fact(name, body, ctes=""):
    ORACLE[name] = FACT + ctes + body


def listed(values):
    return ", ".join(f"'{value}'" for value in values if value is not None)


def member(column, values):
    known = f"{column} IN ({listed(values)})"
    return f"({known} OR {column} IS NULL)" if None in values else f"({known})"


MONEY = "CAST(coalesce(sum(CAST(total_price AS DECIMAL(18,2))), 0) AS DOUBLE)"
HOURS = "coalesce(sum(hour_meter_per_date), 0.0)"
IN_CATEGORIES = member("asset_category", [*CATEGORIES, None])
IN_CODES = member("asset_code", CODES)
COST_PRODUCTS = f"(source = 'hm_record' OR {member('product_name', PRODUCTS)})"

# --- sources ---------------------------------------------------------------------

over_fact("scan_trend_fact", """
SELECT source, asset_category, asset_code, date, product_name, total_price,
       hour_meter_per_date, reset_hm FROM fact""")
over_fact("scan_maintenance_fact", """
SELECT source, asset_category, asset_code, total_hour_meter, date, asset_name, product_id,
       product_name, product_bought_qty, total_price, consume_id_good_consume,
       consume_id_assignment, due_date, fix_hm_record FROM fact""")
over_fact("sql_text", """
SELECT source, asset_category, count(*) AS entries FROM fact GROUP BY source, asset_category""")
over_fact("scan_csv_subset", f"SELECT {', '.join(LISTED_COLUMNS)} FROM fact")
over_fact("split_by_source", """
SELECT asset_code, date, hour_meter_per_date, reset_hm FROM fact WHERE source = 'hm_record'""")
over_fact("split_by_source_cost", """
SELECT asset_code, date, product_name, total_price FROM fact WHERE source = 'good_consume'""")
over_fact("union_sources", """
SELECT source, asset_category, asset_code, date, product_name, total_price,
       total_hour_meter, consume_id_assignment FROM fact""")

# --- selections ------------------------------------------------------------------

over_fact("fill_unknown_category", """
SELECT source, coalesce(asset_category, 'Unknown Category') AS asset_category, count(*) AS entries
FROM fact GROUP BY 1, 2""")
over_fact("coerce_numeric", """
SELECT source, asset_code, date,
       coalesce(TRY_CAST(CASE WHEN product_name IS NULL THEN 'n/a'
         ELSE CAST(CAST(round_even(total_price, 0) AS BIGINT) AS VARCHAR) END AS DOUBLE), 0.0) AS price
FROM fact""")
over_fact("filter_by_category", f"""
SELECT source, asset_category, asset_code, date, product_name FROM fact WHERE {IN_CATEGORIES}""")
over_fact("filter_by_asset", f"""
SELECT source, asset_category, asset_code, date, product_name FROM fact WHERE {IN_CODES}""")
over_fact("filter_by_table", f"""
SELECT source, asset_code, date FROM fact
WHERE asset_code IN (SELECT asset_code FROM users WHERE asset_code IS NOT NULL)
   OR (asset_code IS NULL AND EXISTS (SELECT 1 FROM users WHERE asset_code IS NULL))""", f""",
users AS MATERIALIZED (SELECT DISTINCT asset_code FROM fact WHERE product_name = '{PRODUCTS[0]}')
""")
over_fact("filter_product_on_cost_rows", f"""
SELECT source, asset_code, date, product_name, total_price FROM fact WHERE source = 'hm_record'
UNION ALL
SELECT source, asset_code, date, product_name, total_price FROM fact
WHERE source = 'good_consume' AND {member('product_name', PRODUCTS)}""")
over_fact("filter_date_closed", f"""
SELECT source, asset_code, date FROM fact
WHERE date >= TIMESTAMP '{FIRST_DAY} 00:00:00' AND date <= TIMESTAMP '{LAST_DAY} 23:59:59.999999'""")
over_fact("filter_date_open", f"""
SELECT source, asset_code, date FROM fact
WHERE date >= TIMESTAMP '{FIRST_DAY} 00:00:00' AND date <= TIMESTAMP '{AS_OF}'""")
over_fact("filter_empty_selection", "SELECT source, asset_code, date FROM fact WHERE false")
over_fact("selection_sorted", f"""
SELECT source, asset_category, asset_code, date, product_name FROM fact
WHERE {member('asset_category', CATEGORIES)} AND {COST_PRODUCTS}
  AND date >= TIMESTAMP '{FIRST_DAY} 00:00:00' AND date <= TIMESTAMP '{LAST_DAY} 23:59:59.999999'""")
over_fact("parse_dates_lenient", """
SELECT *, TRY_CAST(due_text AS TIMESTAMP) AS due_date FROM (
  SELECT asset_code, consume_id_good_consume,
         CASE WHEN consume_id_assignment IS NULL THEN 'not due'
              ELSE strftime(due_date, '%Y-%m-%d %H:%M:%S') END AS due_text FROM gc)""")

over_fact("parse_dates_strict", """
SELECT asset_code, consume_id_good_consume, strftime(due_date, '%Y-%m-%d %H:%M:%S') AS due_text,
       CAST(strftime(due_date, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS due_date
FROM gc WHERE due_date IS NOT NULL""")

# --- options ---------------------------------------------------------------------

over_fact("options_category", """
SELECT asset_category, min(date) AS first_date FROM fact GROUP BY 1""")
over_fact("options_asset", f"""
SELECT asset_code, min(date) AS first_date FROM fact WHERE {IN_CATEGORIES} GROUP BY 1""")
over_fact("options_product", f"""
SELECT product_name, min(date) AS first_date FROM fact WHERE {IN_CODES} GROUP BY 1""")

DEFAULTS = """,
first_category AS (
  SELECT asset_category FROM fact GROUP BY 1
  ORDER BY min(date) NULLS LAST, asset_category NULLS LAST LIMIT 1),
in_category AS (
  SELECT * FROM fact WHERE EXISTS (SELECT 1 FROM first_category f
    WHERE f.asset_category IS NOT DISTINCT FROM fact.asset_category)),
codes AS ({codes})
"""
CHOSEN = """
SELECT 'category' AS level, asset_category AS value FROM first_category
UNION ALL SELECT 'asset', asset_code FROM codes
UNION ALL SELECT DISTINCT 'product', product_name FROM fact WHERE EXISTS (
  SELECT 1 FROM codes WHERE codes.asset_code IS NOT DISTINCT FROM fact.asset_code)"""
over_fact("default_selection", CHOSEN, DEFAULTS.format(codes="""
  SELECT asset_code FROM in_category GROUP BY 1
  ORDER BY min(date) NULLS LAST, asset_code NULLS LAST LIMIT 1"""))
over_fact("default_selection_by_category", CHOSEN, DEFAULTS.format(
    codes="SELECT DISTINCT asset_code FROM in_category"))
BOUNDS = "SELECT CAST(min(date) AS DATE) AS first_day, CAST(max(date) AS DATE) AS last_day FROM fact WHERE "
over_fact("date_bounds", BOUNDS + IN_CATEGORIES)
over_fact("date_bounds_asset", BOUNDS + IN_CODES)

# --- headline counts and distribution --------------------------------------------

over_fact("kpi_categories", f"""
SELECT CAST({len(CATEGORIES) + 1} AS BIGINT) AS total_categories,
  count(DISTINCT CASE WHEN source = 'good_consume' THEN asset_category END) AS categories_maintained,
  count(DISTINCT CASE WHEN source = 'hm_record' THEN asset_category END) AS categories_used
FROM fact WHERE {IN_CATEGORIES}""")
over_fact("kpi_assets", f"""
SELECT (SELECT count(*) FROM (SELECT DISTINCT asset_code FROM fact WHERE {IN_CATEGORIES})) AS total_assets,
  count(DISTINCT CASE WHEN source = 'good_consume' THEN asset_code END) AS assets_maintained,
  count(DISTINCT CASE WHEN source = 'hm_record' THEN asset_code END) AS assets_used
FROM fact WHERE {IN_CATEGORIES}""")

MEANS = """,
means AS (
  SELECT source, asset_category,
         CAST(sum(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) / count(total_price) AS price,
         avg(hour_meter_per_date) AS hours,
         count(DISTINCT asset_code) AS distinct_asset_codes
  FROM fact WHERE asset_category IS NOT NULL GROUP BY 1, 2),
rounded AS (
  SELECT source, asset_category, round_even(price, 0) AS mean_total_price,
         round_even(hours, 0) AS mean_hour_meter_per_date, distinct_asset_codes,
         row_number() OVER (PARTITION BY source ORDER BY price DESC NULLS LAST,
           hours DESC NULLS LAST, asset_category) AS place
  FROM means)
"""
over_fact("category_distribution", """
SELECT source, asset_category, mean_total_price, mean_hour_meter_per_date, distinct_asset_codes
FROM rounded""", MEANS)


def shown(amount, prefix, small):
    """Text of a whole amount, in whole-number arithmetic."""
    cases = []
    for power, letter in [(12, "T"), (9, "M"), (6, "jt"), (3, "rb")]:
        unit = 10 ** (power - 2)
        whole, rest = f"({amount} // {unit})", f"({amount} % {unit})"
        up = f"(2 * {rest} > {unit} OR (2 * {rest} = {unit} AND {whole} % 2 = 1))"
        hundredths = f"({whole} + CASE WHEN {up} THEN 1 ELSE 0 END)"
        cases.append(
            f"WHEN {amount} >= {10 ** power} THEN '{prefix}' || ({hundredths} // 100) || ',' || "
            f"lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0') || ' {letter}'"
        )
    return f"CASE {' '.join(cases)} WHEN {amount} IS NOT NULL THEN '{prefix}' || {amount} || '{small}' END"


PAGE = """
SELECT source, asset_category, mean_total_price, mean_hour_meter_per_date, distinct_asset_codes,
       row_number() OVER (ORDER BY place) AS pos, {text}
FROM rounded WHERE source = '{source}' AND place > {start} AND place <= {start} + 10"""
over_fact("distribution_page_cost", PAGE.format(
    source="good_consume", start=10,
    text=shown("CAST(mean_total_price AS BIGINT)", "Rp ", ",00") + " AS price_text"), MEANS)
over_fact("distribution_page_hours", PAGE.format(
    source="hm_record", start=0,
    text=shown("CAST(mean_hour_meter_per_date AS BIGINT)", "", "") + " AS number_text"), MEANS)

# --- trend -----------------------------------------------------------------------

PERIOD = {
    "day": ("date_only", "strftime(date, '%Y-%m-%d')"),
    "week": ("week_column_1", "strftime(date, '%G-W%V')"),
    "month": ("month_column_1", "strftime(date, '%Y-%m')"),
    "quarter": ("quarter_column_1", "strftime(date, '%Y') || '-Q' || quarter(date)"),
    "semester": (
        "semester_column_1",
        "strftime(date, '%Y') || '-S' || CASE WHEN month(date) <= 6 THEN '1' ELSE '2' END",
    ),
    "year": ("year_column", "strftime(date, '%Y')"),
}


def trend(entity, grain, where="true"):
    name, label = PERIOD[grain]
    code = "asset_code, " if entity == "asset" else ""
    hours = "max(hour_meter_per_date)" if grain == "day" else HOURS
    return f"""
SELECT source, asset_category, {code}reset_hm, {label} AS {name}, product_name,
       {MONEY} AS total_price, {hours} AS hour_meter_per_date
FROM fact WHERE {where} GROUP BY ALL"""


for _entity in ["asset", "category"]:
    for _grain in PERIOD:
        over_fact(f"trend_{_entity}_{_grain}", trend(_entity, _grain))
over_fact("trend_asset_selected", trend("asset", "day", f"""
{IN_CODES} AND {COST_PRODUCTS}
AND date >= TIMESTAMP '{FIRST_DAY} 00:00:00' AND date <= TIMESTAMP '{AS_OF}'"""))


def over_trend(name, entity, grain, body):
    over_fact(name, body, f", trend AS ({trend(entity, grain)})")


over_trend("cost_line_asset", "asset", "month", f"""
SELECT month_column_1, asset_code, {MONEY} AS total_price FROM trend GROUP BY 1, 2""")
over_trend("cost_line_category", "category", "week", f"""
SELECT week_column_1, asset_category, {MONEY} AS total_price FROM trend GROUP BY 1, 2""")
over_trend("trend_point", "asset", "month", f"""
SELECT month_column_1, asset_code, {MONEY} AS total_price FROM trend
WHERE month_column_1 = '{PERIODS[0]}' GROUP BY 1, 2""")
over_trend("hours_in_period_range", "asset", "month", f"""
SELECT asset_code, {HOURS} AS hours FROM trend
WHERE month_column_1 BETWEEN '{PERIODS[0]}' AND '{PERIODS[1]}' GROUP BY 1""")
over_trend("hours_in_day_range", "category", "day", f"""
SELECT asset_category, {HOURS} AS hours FROM trend
WHERE date_only BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}' GROUP BY 1""")
over_trend("cost_tooltip_grain", "asset", "day", """
SELECT date_only, asset_code, asset_category, total_price,
       CAST(sum(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS sum_total_price
FROM trend GROUP BY 1, 2, 3, 4""")
over_trend("hours_bar", "asset", "quarter", """
SELECT quarter_column_1, asset_code, asset_category, hour_meter_per_date FROM trend""")
over_trend("cost_vs_hours", "category", "month", f"""
SELECT month_column_1, asset_category, {MONEY} AS total_price, {HOURS} AS hours
FROM trend GROUP BY 1, 2""")
over_trend("cost_vs_hours_day", "asset", "day", f"""
SELECT date_only, asset_code, {MONEY} AS total_price, {HOURS} AS hours FROM trend GROUP BY 1, 2""")
# A day summary gives the rows the fact gives.
for _name, _same in {
    **{f"summary_trend_{of}": f"trend_{of}" for of in
       ["asset_day", "asset_week", "category_day", "category_quarter", "category_year"]},
    "summary_cost_line": "cost_line_category", "summary_hours_in_periods": "hours_in_period_range",
    "summary_cost_vs_hours": "cost_vs_hours",
}.items():
    ORACLE[_name] = ORACLE[_same]
over_trend("reset_events", "asset", "day", """
SELECT date_only AS date, asset_code || ' hour meter is reset' AS annotation
FROM trend WHERE reset_hm = 'true'""")

# --- text ------------------------------------------------------------------------

AMOUNTS = """,
totals AS (
  SELECT asset_code,
         CAST(floor(CAST(sum(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) / 125000) AS HUGEINT) * 125 AS steps
  FROM fact WHERE source = 'good_consume' GROUP BY 1),
amounts AS (
  SELECT asset_code, 0 AS size, steps // 1000 AS whole FROM totals
  UNION ALL SELECT asset_code, 1, steps FROM totals
  UNION ALL SELECT asset_code, 2, steps * 1000 FROM totals
  UNION ALL SELECT asset_code, 3, steps * 100000 FROM totals
  UNION ALL SELECT asset_code, 4, steps * 100000000 FROM totals)
"""
SHOWN = "SELECT asset_code, size, CAST(whole AS DOUBLE) AS amount, {text} AS shown FROM amounts"
over_fact("format_price", SHOWN.format(text=shown("whole", "Rp ", ",00")), AMOUNTS)
over_fact("format_number", SHOWN.format(text=shown("whole", "", "")), AMOUNTS)
# Doubles of this size have no fraction: a whole number of 128 bits is exact.
over_fact("format_large", """
SELECT asset_code, amount, 'Rp ' || text || CASE WHEN amount < 0 THEN ',00' ELSE ',00 T' END AS price,
       text || CASE WHEN amount < 0 THEN '' ELSE ',00 T' END AS number
FROM (SELECT asset_code, amount,
             CAST(CAST(CASE WHEN amount < 0 THEN amount ELSE amount / 1e12 END AS HUGEINT) AS VARCHAR) AS text
      FROM large)""", AMOUNTS + f""",
large AS (SELECT asset_code, CAST(steps AS DOUBLE) * unnest([{', '.join(f'{x:.0e}::DOUBLE' for x in LARGE_FACTORS)}]) AS amount
          FROM totals WHERE steps > 0)""")
over_trend("format_grouped", "category", "quarter", """
SELECT *, format('{:,}', CAST(round(total_price) AS BIGINT)) AS shown FROM (
  SELECT quarter_column_1, asset_category, """ + MONEY + """ AS total_price
  FROM trend GROUP BY 1, 2)""")

# --- service history -------------------------------------------------------------

LINE = "asset_category, asset_code, asset_name, product_id"
KEYS7 = f"{LINE}, product_name, date, consume_id_good_consume"
SERVICE = f""",
hmd AS (
  SELECT coalesce(asset_category, 'Unknown Category') AS asset_category, asset_code,
         date AS asset_used_at, max(total_hour_meter) AS hour_meter
  FROM hm WHERE asset_code IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2, 3),
gcd AS (
  SELECT * REPLACE (coalesce(asset_category, 'Unknown Category') AS asset_category) FROM gc),
gc_agg AS (
  SELECT {KEYS7}, coalesce(sum(product_bought_qty), 0.0) AS product_bought_qty, {MONEY} AS total_price
  FROM gcd WHERE asset_code IS NOT NULL AND asset_name IS NOT NULL AND product_id IS NOT NULL
    AND product_name IS NOT NULL AND date IS NOT NULL AND consume_id_good_consume IS NOT NULL
  GROUP BY {KEYS7}),
events AS (SELECT DISTINCT consume_id_assignment, due_date, fix_hm_record FROM gcd),
merged AS (
  SELECT gc_agg.*, consume_id_assignment, CAST(due_date AS DATE) AS due_day, fix_hm_record
  FROM gc_agg LEFT JOIN events ON consume_id_good_consume = consume_id_assignment),
lowest AS (SELECT {LINE}, min(fix_hm_record) AS min_meter FROM merged GROUP BY {LINE}),
filtered AS (
  SELECT merged.*, asset_used_at FROM merged JOIN hmd
  ON merged.asset_category = hmd.asset_category AND merged.asset_code = hmd.asset_code
  AND due_day = CAST(asset_used_at AS DATE)),
sequence AS (
  SELECT *, fix_hm_record - lag(fix_hm_record) OVER (
    PARTITION BY {LINE} ORDER BY due_day, product_name, date, consume_id_good_consume,
    fix_hm_record NULLS LAST, asset_used_at) AS diff
  FROM filtered),
intervals AS (
  SELECT *, coalesce(diff, fix_hm_record - min_meter) AS serviced_when
  FROM sequence JOIN lowest USING ({LINE})),
counted AS (
  SELECT *, round_even(avg(serviced_when) OVER (PARTITION BY {LINE}), 0) AS avg_serviced_when,
         count(due_day) OVER (PARTITION BY {LINE}) AS service_count
  FROM intervals),
df_new AS (
  SELECT asset_category, asset_code, asset_name, product_name, service_count,
         consume_id_good_consume, avg(avg_serviced_when) AS avg_service
  FROM counted GROUP BY 1, 2, 3, 4, 5, 6),
hm_agg AS (
  SELECT asset_category, asset_code, max(asset_used_at) AS latest_asset_used_at,
         max(hour_meter) AS latest_used_hour_meter FROM hmd GROUP BY 1, 2),
svc AS (
  SELECT consume_id_assignment, max(due_date) AS latest_product_maintained_at,
         max(fix_hm_record) AS maintained_hour_meter
  FROM fact WHERE consume_id_assignment IS NOT NULL GROUP BY 1),
used AS (SELECT * FROM df_new FULL JOIN hm_agg USING (asset_category, asset_code)),
serviced AS (SELECT * FROM used FULL JOIN svc ON consume_id_good_consume = consume_id_assignment),
hours AS (
  SELECT *, latest_used_hour_meter - maintained_hour_meter AS hours_after_maintained FROM serviced),
rows_ AS (
  SELECT *, CASE
    WHEN hours_after_maintained > avg_service THEN 'Needed service'
    WHEN hours_after_maintained >= avg_service - 24 AND hours_after_maintained <= avg_service
      THEN 'Incoming Service'
    WHEN hours_after_maintained < avg_service THEN 'Good condition'
    WHEN product_name IS NULL AND latest_asset_used_at IS NOT NULL
      THEN 'Product not registered in good consume record' END AS status,
    coalesce(consume_id_good_consume, consume_id_assignment) AS service_number
  FROM hours),
report AS (
  SELECT asset_category, asset_code, asset_name, product_name, status, service_count,
         latest_product_maintained_at, maintained_hour_meter, latest_asset_used_at,
         latest_used_hour_meter, avg_service, hours_after_maintained FROM rows_)
"""


def over_service(name, body, ctes=""):
    over_fact(name, body, SERVICE + ctes)


over_service("hour_readings", "SELECT * FROM hmd")
over_service("consumption_agg", "SELECT * FROM gc_agg")
over_service("distinct_service_events", "SELECT * FROM events")
over_service("join_consume_assignment", f"""
SELECT {KEYS7}, consume_id_assignment, due_day,
       CASE WHEN consume_id_assignment IS NOT NULL THEN count(*) END AS events,
       CASE WHEN consume_id_assignment IS NOT NULL THEN count(fix_hm_record) END AS metered,
       min(fix_hm_record) AS lowest_meter, max(fix_hm_record) AS highest_meter
FROM merged GROUP BY {KEYS7}, consume_id_assignment, due_day""")
over_service("service_events_matched", f"""
SELECT {KEYS7}, due_day, max(fix_hm_record) AS highest_meter,
       CASE WHEN count(fix_hm_record) = count(*) THEN max(fix_hm_record) END AS closing_meter,
       count(*) AS pairs, count(fix_hm_record) AS metered_pairs
FROM filtered GROUP BY {KEYS7}, due_day""")
over_service("service_interval", f"""
SELECT {KEYS7}, due_day, sum(serviced_when) AS serviced_when, count(*) AS pairs,
       avg_serviced_when, service_count
FROM counted GROUP BY {KEYS7}, due_day, avg_serviced_when, service_count""")
over_service("avg_service_interval", "SELECT * FROM df_new")
over_service("latest_service", "SELECT * FROM svc")
over_service("latest_reading", "SELECT * FROM hm_agg")
over_service("join_latest_reading", "SELECT * FROM used")
over_service("join_latest_service", "SELECT * FROM serviced")
over_service("assets_without_products", """
SELECT * FROM hm_agg WHERE NOT EXISTS (SELECT 1 FROM df_new
  WHERE df_new.asset_category = hm_agg.asset_category AND df_new.asset_code = hm_agg.asset_code)""")
over_service("status_report", "SELECT * FROM report")
IN_REPORT = member("asset_category", CATEGORIES)
over_service("status_filtered", f"SELECT * FROM report WHERE {IN_REPORT}")
over_service("status_filtered_by_code", f"SELECT * FROM report WHERE {IN_CODES}")
over_service("status_filtered_by_both", f"SELECT * FROM report WHERE {IN_REPORT} AND {IN_CODES}")
over_service("status_detail", f"SELECT * FROM report WHERE status IN ({listed(STATUSES[:2])})")
over_service("report_options_category", "SELECT DISTINCT asset_category FROM report")
over_service("report_options_asset", f"SELECT DISTINCT asset_code FROM report WHERE {IN_REPORT}")
NEEDED = """,
needed AS (
  SELECT asset_category, asset_code, asset_name, count(*) AS "count"
  FROM report WHERE status = 'Needed service' AND asset_category IS NOT NULL
    AND asset_code IS NOT NULL AND asset_name IS NOT NULL GROUP BY 1, 2, 3)
"""
over_service("needed_service_count", "SELECT * FROM needed", NEEDED)
over_service("top10_needed_service", """
SELECT *, row_number() OVER (ORDER BY "count" DESC, asset_category, asset_code, asset_name) AS pos
FROM needed QUALIFY pos <= 10""", NEEDED)
SHOWN_ROWS = f"SELECT * FROM rows_ WHERE status IN ({listed(STATUSES)})"
STATUS_PAGE = f"""
SELECT asset_category, asset_code, asset_name, product_name, status, service_count,
       latest_product_maintained_at, maintained_hour_meter, latest_asset_used_at,
       latest_used_hour_meter, avg_service, hours_after_maintained, place - {{start}} AS pos
FROM (SELECT *, row_number() OVER (ORDER BY service_number NULLS LAST, asset_category NULLS LAST,
        asset_code NULLS LAST, asset_name NULLS LAST, product_name NULLS LAST,
        service_count NULLS LAST) AS place
      FROM ({SHOWN_ROWS}))
WHERE place > {{start}} AND place <= {{start}} + 20"""
over_service("status_page", STATUS_PAGE.format(start=20))
over_service("status_page_deep", STATUS_PAGE.format(start=20 * DEEP_PAGE))
_LAST = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in PAGE_LAST.values())
over_service("status_page_after", f"""
SELECT asset_category, asset_code, asset_name, product_name, status, service_count,
       latest_product_maintained_at, maintained_hour_meter, latest_asset_used_at,
       latest_used_hour_meter, avg_service, hours_after_maintained, place AS pos
FROM (SELECT *, row_number() OVER (ORDER BY service_number NULLS LAST, asset_category NULLS LAST,
        asset_code NULLS LAST, asset_name NULLS LAST, product_name NULLS LAST,
        service_count NULLS LAST) AS place
      FROM ({SHOWN_ROWS}) WHERE
        (service_number IS NULL, coalesce(service_number, 0), asset_category IS NULL, coalesce(asset_category, ''),
         asset_code IS NULL, coalesce(asset_code, ''), asset_name IS NULL, coalesce(asset_name, ''),
         product_name IS NULL, coalesce(product_name, ''), service_count IS NULL, coalesce(service_count, 0))
        > ({', '.join(f"false, {v}" for v in _LAST.split(", "))}))
WHERE place <= 20""")
over_service("status_page_count", f"""
SELECT count(*) AS total_rows,
       count(*) // 20 + CASE WHEN count(*) % 20 > 0 THEN 1 ELSE 0 END AS total_pages
FROM ({SHOWN_ROWS})""")

# --- product names ---------------------------------------------------------------

WRITTEN = f"""
WITH branded AS (
  SELECT *, [{listed(BRANDS)}][p_partkey % {len(BRANDS)} + 1] AS brand FROM part),
written AS (
  SELECT CASE
    WHEN p_size > 40 THEN upper(brand[1]) || brand[2:] || ' ' || p_size || 'W40'
    WHEN p_size > 30 THEN split_part(p_name, ' ', 1) || ' (' || brand || ')'
    ELSE upper(brand) || ' ' || p_brand || ' ' || p_name || ' (asli)' END AS product_name
  FROM branded)
"""


def cleaned(source):
    text = "regexp_replace(product_name, '\\b\\w*\\d\\w*\\b', '', 'g')"
    text = f"regexp_replace({text}, '\\b(?:{'|'.join(BRANDS)})\\b', '', 'gi')"
    text = f"trim(regexp_replace(regexp_replace({text}, '[^a-zA-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"""
names AS (
  SELECT product_name, "rows", cleaned_product_name,
    CASE WHEN cleaned_product_name = '' THEN 0
         ELSE len(string_split(cleaned_product_name, ' ')) END AS words
  FROM (SELECT product_name, count(*) AS "rows",
          array_to_string(string_split({text}, ' ')[1:2], ' ') AS cleaned_product_name
        FROM {source} WHERE product_name IS NOT NULL GROUP BY product_name))
"""


ORACLE["clean_product_name"] = f"""{WRITTEN}, {cleaned('written')}
SELECT product_name, "rows", cleaned_product_name, CAST(words AS INTEGER) AS words FROM names"""
ORACLE["split_by_word_count"] = f"""{WRITTEN}, {cleaned('written')}
SELECT CASE WHEN words = 1 THEN 'one word' ELSE 'several words' END AS kind,
       cleaned_product_name, "rows" FROM names WHERE words > 0"""
over_fact("tfidf_terms", """
SELECT cleaned_product_name, "rows", term,
       round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY cleaned_product_name)), 9) AS weight
FROM counted JOIN rarity USING (term)""", f""",
{cleaned('gc')},
documents AS (
  SELECT cleaned_product_name, CAST(sum("rows") AS BIGINT) AS "rows"
  FROM names WHERE words > 1 GROUP BY 1),
terms AS (
  SELECT cleaned_product_name, "rows",
         unnest(string_split(lower(cleaned_product_name), ' ')) AS term FROM documents),
counted AS (
  SELECT cleaned_product_name, "rows", term, count(*) AS tf
  FROM terms WHERE length(term) >= 2 GROUP BY 1, 2, 3),
rarity AS (
  SELECT term, ln((1 + (SELECT sum("rows") FROM documents)) / (1 + sum("rows"))) + 1 AS idf
  FROM counted GROUP BY 1)
""")

# With at least as many clusters as there are different names, each name's terms are a
# cluster of their own: its label is its terms, later letters first.
MAPPED = f""",
{cleaned('gc')},
spelled AS (
  SELECT product_name, cleaned_product_name, words,
         list_sort(list_distinct(list_filter(string_split(lower(cleaned_product_name), ' '),
                                             lambda t: length(t) >= 2)), 'DESC') AS terms
  FROM names WHERE words > 0),
mapping AS (
  SELECT product_name, upper(CASE WHEN words = 1 OR len(terms) = 0 THEN cleaned_product_name
                                  ELSE array_to_string(terms, ' ') END) AS product_subcategory
  FROM spelled)
"""
over_fact("product_subcategory", "SELECT * FROM mapping", MAPPED)

# The service history once more, with the subcategory as one more key of a line.
_BY_SUBCATEGORY = (
    SERVICE.replace("SELECT * REPLACE (coalesce(asset_category, 'Unknown Category') AS asset_category) FROM gc)",
                    "SELECT gc.* REPLACE (coalesce(asset_category, 'Unknown Category') AS asset_category), "
                    "product_subcategory FROM gc JOIN mapping USING (product_name))")
    .replace(LINE, f"{LINE}, product_subcategory")
    .replace("SELECT asset_category, asset_code, asset_name, product_name, service_count,\n         consume_id_good_consume",
             "SELECT asset_category, asset_code, asset_name, product_subcategory, product_name, service_count,\n"
             "         consume_id_good_consume")
    .replace("FROM counted GROUP BY 1, 2, 3, 4, 5, 6)", "FROM counted GROUP BY 1, 2, 3, 4, 5, 6, 7)")
    .replace("SELECT asset_category, asset_code, asset_name, product_name, status,",
             "SELECT asset_category, asset_code, asset_name, product_subcategory, product_name, status,")
)
over_fact("status_report_subcategory", "SELECT * FROM report", MAPPED + _BY_SUBCATEGORY)
over_fact("status_filtered_subcategory", f"""
SELECT * FROM kept WHERE {IN_REPORT} AND (
  product_subcategory IN (SELECT product_subcategory FROM chosen WHERE product_subcategory IS NOT NULL)
  OR (product_subcategory IS NULL AND EXISTS (SELECT 1 FROM chosen WHERE product_subcategory IS NULL)))""",
          MAPPED + _BY_SUBCATEGORY + f""",
kept AS MATERIALIZED (SELECT * FROM report),
chosen AS MATERIALIZED (SELECT DISTINCT product_subcategory FROM kept WHERE {member('asset_category', CATEGORIES[:1])})
""")
