"""What the plans must and must not contain."""

import re

from checks import queries
from checks.queries import QUERIES
from tests.conftest import FOLDER


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_product_filter_reads_each_source_once(spark):
    plan = plan_of(QUERIES["filter_product_on_cost_rows"](spark, FOLDER))
    assert plan.count("lineitem.parquet") == 2


def test_trend_aggregates_before_its_shuffle(spark):
    plan = plan_of(QUERIES["trend_asset_month"](spark, FOLDER))
    assert "partial_sum" in plan


def test_columns_are_pruned(spark):
    plan = plan_of(QUERIES["latest_reading"](spark, FOLDER))
    assert "l_extendedprice" not in plan and "l_quantity" not in plan


def test_pages_are_bounded_top_k(spark):
    for name in ["top10_needed_service", "status_page", "distribution_page_cost"]:
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, FOLDER))


def test_report_reads_the_staged_tables(spark):
    """Services in three branches, and the line statistics made from them; none
    repeats the joins behind these."""
    plan = plan_of(QUERIES["status_report"](spark, FOLDER))
    assert plan.count("/services-") == 3
    assert plan.count("/statistics-") == 1
    assert "lineitem" not in plan


def test_default_selection_reads_the_fact_once(spark):
    """The fact is read for a small written table; the choices come from that."""
    plan = plan_of(QUERIES["default_selection"](spark, FOLDER))
    assert "lineitem" not in plan and "/options-" in plan


def test_the_fact_is_written_once(spark):
    plans = [plan_of(QUERIES[name](spark, FOLDER)) for name in ["latest_service", "status_report", "status_page_count"]]
    assert all("lineitem" not in plan for plan in plans[1:])
    paths = {re.search(r"/fact-[0-9a-f]+", queries._maintenance_fact(spark, FOLDER).inputFiles()[0]).group() for _ in range(2)}
    assert len(paths) == 1


def test_history_by_subcategory_reads_the_written_fact(spark, monkeypatch):
    """Not the tables it is made of, whose joins each branch would repeat."""
    seen = []
    made = queries.ServiceHistory
    monkeypatch.setattr(queries, "ServiceHistory", lambda *a: seen.append(made(*a)) or seen[-1])
    for name in ["status_report_subcategory", "status_filtered_subcategory"]:
        QUERIES[name](spark, FOLDER)
        plan = plan_of(seen.pop().fact)
        assert "lineitem" not in plan and "/fact-" in plan
