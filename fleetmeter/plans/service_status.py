"""The service status view: report, filters, ranking and pages."""

from functools import cached_property

from pyspark.sql import functions as F

from fleetmeter.fixed_values import REPORT_PAGE, STATUSES
from fleetmeter.operators import intervals, maintenance, ranking, status
from fleetmeter.operators.paging import PageDirectory, ascending, page, page_after, page_count
from fleetmeter.operators.predicates import is_member, optional
from fleetmeter.sources.shaping import cost_rows
from fleetmeter.sources.staging import staged, staged_alone

# Service number first, rows without one last; the rest makes the order total.
PAGE_ORDER = ascending(
    "service_number", "asset_category", "asset_code", "asset_name", "product_name", "service_count"
)


class ServiceHistory:
    """Stages of the service status of one maintenance fact.

    A table that may join a hot key is written first. Adaptive execution splits a hot
    key only where both sides of the join come straight from a shuffle, and a grouped
    table that still has its grouping's partitioning is not shuffled again. Each write
    ends with its shuffle files, and tables that only lead to another go with it, so the
    disk holds one step of the history at a time.

    `extra` names columns of the cost rows that split product lines further, such
    as a subcategory; `costs` replaces the fact's own cost rows. `stretches` sets
    how many tasks sort the services, by default as many as their size asks for.
    """

    def __init__(self, fact, costs=None, extra=(), stretches=None):
        self.fact = fact
        self.costs = cost_rows(fact) if costs is None else costs
        self.extra = tuple(extra)
        self.stretches = stretches

    @cached_property
    def services(self):
        """Matched services, written once: several branches of the report read them."""
        spark = self.fact.sparkSession

        def ordered():
            matched = staged_alone(spark, "matched", self._matched)
            return intervals.in_stretches(matched, self.extra, self.stretches)

        return staged_alone(spark, "services", ordered)

    def _matched(self):
        read = maintenance.reading_days(maintenance.hour_readings(self.fact))
        return maintenance.matched_services(self.costs, staged(read, "days"), self.extra)

    @cached_property
    def lowest_meters(self):
        lowest = staged(maintenance.lowest_by_number(self.costs), "lowest")
        return maintenance.lowest_meters(self.costs, lowest, self.extra)

    @cached_property
    def latest_readings(self):
        return staged(maintenance.latest_readings(self.fact), "readings")

    @cached_property
    def latest_services(self):
        return staged(maintenance.latest_services(self.fact), "latest")

    @cached_property
    def line_statistics(self):
        return staged(
            intervals.line_statistics(self.services, self.lowest_meters, self.extra), "statistics"
        )

    def service_intervals(self):
        return intervals.service_intervals(
            self.services, self.line_statistics, self.extra
        )

    def mean_intervals(self):
        return intervals.mean_intervals(self.services, self.line_statistics, self.extra)

    def with_latest_reading(self):
        return status.with_latest_reading(
            self.mean_intervals(), self.services, self.latest_readings
        )

    def with_latest_service(self):
        return status.with_latest_service(
            self.with_latest_reading(), self.services, self.latest_services
        )

    def assets_without_products(self):
        return status.assets_without_products(self.services, self.latest_readings)

    def classified(self):
        """Report rows with their service number, which orders the pages."""
        number = F.coalesce("consume_id_good_consume", "consume_id_assignment")
        return status.classify(self.with_latest_service()).withColumn("service_number", number)

    def report(self):
        return status.report_columns(self.classified(), self.extra)


def status_report(fact, costs=None, extra=()):
    """Service status of every product on every asset."""
    return ServiceHistory(fact, costs, extra).report()


def filtered(report, categories=(), codes=(), **others):
    """Report rows of the chosen categories and codes; nothing chosen keeps all."""
    return report.where(optional({"asset_category": categories, "asset_code": codes, **others}))


def detail(report, statuses=None):
    """Rows of the chosen statuses; unclassified rows are never among them."""
    return report.where(is_member("status", STATUSES if statuses is None else statuses))


def detail_page(history, number=0, statuses=None, size=REPORT_PAGE, **selections):
    """One page of the report, with `pos`, the place on the page."""
    rows = detail(filtered(history.classified(), **selections), statuses)
    return _on_page(history, rows, page(rows, PAGE_ORDER, size, number))


def detail_page_after(history, last, statuses=None, size=REPORT_PAGE, **selections):
    """The page that follows the row `last`, a mapping of the columns of PAGE_ORDER."""
    rows = detail(filtered(history.classified(), **selections), statuses)
    return _on_page(history, rows, page_after(rows, PAGE_ORDER, size, last))


class DetailPages:
    """The report's pages by number: written in order once, then read page by page."""

    def __init__(self, history, statuses=None, stretches=None, **selections):
        rows = detail(filtered(history.classified(), **selections), statuses)
        self.names = status.report_columns(rows, history.extra).columns
        self.directory = PageDirectory(rows, PAGE_ORDER, stretches)

    def page(self, number=0, size=REPORT_PAGE):
        return self.directory.page(size, number).select(*self.names, "pos")

    def counts(self, size=REPORT_PAGE):
        return self.directory.counts(size)


def _on_page(history, rows, paged):
    names = status.report_columns(rows, history.extra).columns
    return ranking.numbered(paged, PAGE_ORDER).select(*names, "pos")


def detail_page_count(history, statuses=None, size=REPORT_PAGE, **selections):
    return page_count(detail(filtered(history.report(), **selections), statuses), size)
