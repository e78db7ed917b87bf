"""Service intervals and status, by hand and against brute force."""

import datetime
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetmeter.fixed_values import STATUSES
from fleetmeter.operators import maintenance, paging, ranking
from fleetmeter.operators.status import service_status
from fleetmeter.plans import service_status as plan
from fleetmeter.plans.service_status import ServiceHistory, status_report
from fleetmeter.schema import MAINTENANCE_SCHEMA
from fleetmeter.sources import shaping
from fleetmeter.sources.staging import temporary_tables
from fleetmeter.sources.star import star_fact
from tests import brute_force
from tests.conftest import FOLDER

D = datetime.datetime


def reading(meter, date, code="X1"):
    return dict(source="hm_record", asset_category="C", asset_code=code, asset_name="Unit",
                total_hour_meter=meter, date=date)


def service(number, due, meter, **other):
    row = dict(source="good_consume", asset_category="C", asset_code="X1", asset_name="Unit",
               product_id=1, product_name="pump", date=due, due_date=due, fix_hm_record=meter,
               consume_id_good_consume=number, consume_id_assignment=number,
               product_bought_qty=1.0, total_price=1.0)
    return {**row, **other}


DAYS = [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)]
SERVICES = [service(n + 1, DAYS[n], m) for n, m in enumerate([100.0, 600.0, 1100.0])]
READINGS = [reading(m, d) for m, d in zip([100.0, 600.0, 1100.0], DAYS)]


@pytest.mark.parametrize("last, hours, status", [
    (1434.0, 334.0, "Needed service"),
    (1433.0, 333.0, "Incoming Service"),
    (1409.0, 309.0, "Incoming Service"),
    (1408.0, 308.0, "Good condition"),
])
def test_status_of_the_last_service(maintenance_fact, last, hours, status):
    fact = maintenance_fact(SERVICES + READINGS + [reading(last, D(2024, 3, 10))])
    row = status_report(fact).where("maintained_hour_meter = 1100").first()
    assert (row["avg_service"], row["service_count"]) == (333.0, 3)
    assert (row["hours_after_maintained"], row["status"]) == (hours, status)


def statistics(fact):
    return {
        (r["asset_category"], r["asset_code"], r["asset_name"], r["product_id"]):
            (r["avg_serviced_when"], r["service_count"])
        for r in ServiceHistory(fact).line_statistics.collect()
    }


LINE = ("C", "X1", "Unit", 1)


def test_null_meter_inside_the_sequence(maintenance_fact):
    days = [D(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = [service(n, d, m) for n, (d, m) in enumerate(zip(days, [10.0, None, 30.0, 35.0]))]
    fact = maintenance_fact(rows + [reading(1.0, d) for d in days])
    gaps = ServiceHistory(fact).service_intervals().orderBy("due_day").collect()
    assert [r["serviced_when"] for r in gaps] == [0.0, None, 20.0, 5.0]
    assert statistics(fact) == {LINE: (8.0, 4)}


def test_readings_of_one_day_multiply(maintenance_fact):
    fact = maintenance_fact(SERVICES + READINGS + [reading(601.0, D(2024, 2, 1, 9))])
    assert statistics(fact) == {LINE: (250.0, 4)}


def test_unread_service_still_sets_the_minimum(maintenance_fact):
    fact = maintenance_fact(SERVICES + READINGS[1:])
    assert statistics(fact) == {LINE: (500.0, 2)}


def random_rows(seed):
    rng = random.Random(seed)
    some = lambda value, share=0.15: None if rng.random() < share else value
    day = lambda: D(2024, 1, 1 + rng.randrange(6), rng.choice([0, 0, 5]))
    products = {0: "pump", 1: "hose", 2: "pump", 3: None}
    rows = []
    for _ in range(60):
        asset = rng.choice([0, 0, 0, 1, 2, 3])
        base = dict(asset_category=["A", "B", None, "A"][asset], asset_code=some(f"X{asset}", 0.03),
                    asset_name=f"Unit {asset}")
        if rng.random() < 0.45 or asset == 3:
            rows.append(dict(base, source="hm_record", date=some(day(), 0.05),
                             total_hour_meter=some(float(rng.randrange(400)))))
        else:
            product = rng.choice([0, 0, 1, 2, 3])
            number = rng.randrange(12)
            rows.append(dict(base, source="good_consume", date=some(day(), 0.05),
                             product_id=some(product, 0.03), product_name=products[product],
                             consume_id_good_consume=some(number, 0.05),
                             consume_id_assignment=some(rng.choice([number, rng.randrange(14)])),
                             due_date=some(day()), fix_hm_record=some(float(rng.randrange(300))),
                             product_bought_qty=1.0, total_price=2.0))
    rows += rng.choices(rows, k=10)
    return [{f.name: r.get(f.name) for f in MAINTENANCE_SCHEMA} for r in rows]


def rounded(rows):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows)


@pytest.mark.parametrize("seed, stretches", [(1, None), (2, 5), (3, 20), (4, 9), (5, 30), (6, 3)])
def test_report_equals_brute_force(maintenance_fact, seed, stretches):
    """Also with lines cut into so many stretches that values pass between them."""
    rows = random_rows(seed)
    expected, lines = brute_force.status_report(rows)
    history = ServiceHistory(maintenance_fact(rows), stretches=stretches)
    if stretches:
        assert history.services.select("stretch").distinct().count() > 2
    assert rounded(history.report().collect()) == rounded(expected)
    keys = ["asset_category", "asset_code", "asset_name", "product_id"]
    found = {
        tuple(r[k] for k in keys): (r["avg_serviced_when"], r["service_count"])
        for r in history.line_statistics.collect()
    }
    assert found == lines
    totals = history.service_intervals().groupBy(*keys).agg(
        F.bround(F.sum("serviced_when") / F.sum(F.when(F.col("serviced_when").isNotNull(), 1)), 0),
        F.sum("pairs"),
    )
    assert {tuple(r[:4]): r[5] for r in totals.collect()} == {k: v[1] for k, v in lines.items()}


def test_exactly_one_status_given_values(spark):
    hours = [0.0, 75.9, 76.0, 99.0, 100.0, 100.1]
    frame = spark.createDataFrame([(h, 100.0) for h in hours], "h double, a double")
    shown = frame.select(service_status(F.col("h"), F.col("a"), F.lit("p"), F.lit(None))).collect()
    good, incoming, needed = STATUSES[2], STATUSES[1], STATUSES[0]
    assert [r[0] for r in shown] == [good, good, incoming, incoming, incoming, needed]


@pytest.fixture(scope="module")
def star_history(spark):
    history = ServiceHistory(star_fact(spark, FOLDER))
    history.kept = history.report().cache()
    return history


def test_status_counts(star_history):
    counts = {r[0]: r[1] for r in star_history.kept.groupBy("status").count().collect()}
    assert counts == {STATUSES[0]: 2953, STATUSES[1]: 12, STATUSES[2]: 1239, STATUSES[3]: 1, None: 73}


def test_filters_compose_in_any_order(star_history):
    report = star_history.kept
    categories = [r[0] for r in report.select("asset_category").distinct().limit(2).collect()]
    one = plan.detail(plan.filtered(report, categories=categories), STATUSES[:2]).count()
    two = plan.filtered(plan.detail(report, STATUSES[:2]), categories=categories).count()
    assert one == two > 0
    assert plan.filtered(report).count() == report.count()


def test_needed_counts_and_top(star_history):
    counts = ranking.needed_service_counts(star_history.kept).collect()
    assert sum(r["count"] for r in counts) == 2953
    top = ranking.top_needed_service(star_history.kept, 3).orderBy("pos").collect()
    ranked = sorted(counts, key=lambda r: (-r["count"], r[0], r[1], r[2]))[:3]
    assert [r["asset_code"] for r in top] == [r["asset_code"] for r in ranked]


def test_pages_make_the_whole(star_history):
    total = plan.detail_page_count(star_history, [STATUSES[1]], size=3).first()
    assert total == (12, 4)
    paged = [r for n in range(4) for r in
             plan.detail_page(star_history, n, [STATUSES[1]], size=3).orderBy("pos").collect()]
    whole = plan.detail(star_history.kept, [STATUSES[1]]).collect()
    assert Counter(r[:-1] for r in paged) == Counter(tuple(r) for r in whole)


def test_page_after_follows_page(spark):
    values = [(a, b) for a in (1, 2, None) for b in ("x", "y", None)]
    frame = spark.createDataFrame(values, "a int, b string")
    order = [("a", True), ("b", False)]
    whole = [tuple(r) for r in paging.page(frame, order, 9).collect()]
    walked, last = [], None
    while True:
        rows = (paging.page(frame, order, 2) if last is None
                else paging.page_after(frame, order, 2, last)).collect()
        if not rows:
            break
        walked += [tuple(r) for r in rows]
        last = rows[-1].asDict()
    assert walked == whole


def test_consumption_sums(maintenance_fact):
    rows = [service(1, DAYS[0], 1.0, total_price=0.1), service(1, DAYS[0], 2.0, total_price=0.2),
            service(1, DAYS[0], 2.0, product_name=None)]
    found = maintenance.consumption(maintenance_fact(rows)).collect()
    assert [(r["product_bought_qty"], r["total_price"]) for r in found] == [(2.0, 0.3)]


def test_shared_service_number_does_not_multiply(maintenance_fact):
    """One number on many consumptions and many days, of which few are read."""
    many = 300
    day = datetime.datetime(2024, 1, 1)
    common = dict(asset_category="C", asset_code="X", asset_name="U", product_id=1, product_name="pump")
    rows = [dict(source="good_consume", **common, date=day + datetime.timedelta(i), due_date=day + datetime.timedelta(i),
                 consume_id_good_consume=0, consume_id_assignment=0, fix_hm_record=float(i)) for i in range(many)]
    rows += [dict(source="hm_record", asset_category="C", asset_code="X", asset_name="U", total_hour_meter=1.0,
                  date=day + datetime.timedelta(i)) for i in (3, 4)]
    fact = maintenance_fact(rows)
    read = maintenance.reading_days(maintenance.hour_readings(fact))
    paired = maintenance.consumption_services(shaping.cost_rows(fact), how="inner", read=read)
    assert paired.count() == 2 * many
    assert maintenance.matched_services(shaping.cost_rows(fact), read).count() == 2 * many


@pytest.mark.parametrize("seed, few", [(1, 0), (2, 1), (3, 2), (7, 0), (8, 3)])
def test_busy_numbers_change_no_report(maintenance_fact, monkeypatch, seed, few):
    """Numbers of more than `few` days take the way of busy ones."""
    monkeypatch.setattr(maintenance, "FEW_DAYS", few)
    rows = random_rows(seed)
    expected, _ = brute_force.status_report(rows)
    assert rounded(ServiceHistory(maintenance_fact(rows)).report().collect()) == rounded(expected)


def _shared_number(spark, assets, read_on):
    """A fact of one number on as many assets as days, as a table; `read_on` gives each asset's reading days."""
    rows = spark.range(assets).select("id", F.explode(F.concat(F.array(F.lit(-1).cast("long")), read_on)).alias("on"))
    base = F.lit("2000-01-01").cast("timestamp_ntz")
    day = lambda number: base + F.make_dt_interval(number.cast("int"))
    service_row, code = F.col("on") < 0, F.concat(F.lit("X"), F.col("id").cast("string"))
    at = F.when(service_row, F.col("id")).otherwise(F.col("on"))
    values = {
        "source": F.when(service_row, "good_consume").otherwise("hm_record"), "asset_category": F.lit("C"),
        "asset_code": code, "asset_name": code, "date": day(at), "due_date": F.when(service_row, day(at)),
        "product_id": F.when(service_row, 1), "product_name": F.when(service_row, "pump"),
        "consume_id_good_consume": F.when(service_row, 0), "consume_id_assignment": F.when(service_row, 0),
        "fix_hm_record": F.when(service_row, F.col("id")), "total_hour_meter": F.when(~service_row, F.col("on")),
    }
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MAINTENANCE_SCHEMA])


@pytest.mark.parametrize("often", [False, True])
def test_number_of_many_assets_and_days(spark, often):
    """5,000 assets and 5,000 days of one number; assets read on two days, or one on every day, too."""
    many = 5000
    own = F.array(F.col("id"), (F.col("id") * 7 + 1) % many)
    read_on = F.when(F.col("id") == 3, F.sequence(F.lit(0), F.lit(many - 1))).otherwise(own) if often else own
    fact = _shared_number(spark, many, F.array_distinct(read_on).cast("array<bigint>"))
    read = maintenance.reading_days(maintenance.hour_readings(fact))
    costs = shaping.cost_rows(fact)
    matched = maintenance.matched_services(costs, read)
    days = maintenance.service_days(maintenance.service_events(costs))
    pairs = maintenance.pairs_to_serve(maintenance.consumption(costs), maintenance.busy_numbers(days), read)
    tried = [part.count() for part in maintenance.days_to_try(pairs, days, read)]
    found, result = matched.count(), read.count()
    assert found == result >= 2 * many - 10
    assert sum(tried) <= found


def test_days_of_service_are_found_in_narrow_rows(spark, maintenance_fact):
    """Many rows lie between services and readings; none of them carries an asset's or a product's name."""
    fact = maintenance_fact(random_rows(4))
    read = maintenance.reading_days(maintenance.hour_readings(fact))
    plan_text = maintenance.matched_services(shaping.cost_rows(fact), read)._jdf.queryExecution().executedPlan().toString()
    sides = [line for line in plan_text.split("\n") if "FileScan" in line]
    assert len(sides) == 2 and plan_text.count("due_day") > 0
    narrow, = [line for line in sides if "product_name" not in line]
    assert not any(name in narrow for name in ("asset_code", "asset_category", "asset_name"))


def test_history_keeps_no_step_on_disk(spark, maintenance_fact):
    """What only led to another table is gone once that is written."""
    with temporary_tables(spark) as folder:
        ServiceHistory(maintenance_fact(random_rows(5))).report()
        kept = sorted(name.split("-")[0] for name in os.listdir(folder) if os.listdir(f"{folder}/{name}"))
    assert kept == ["latest", "lowest", "readings", "services", "statistics"]


@pytest.mark.parametrize("seed, few", [(1, 0), (3, 2)])
def test_matched_services_by_hand(maintenance_fact, monkeypatch, seed, few):
    """Each consumption with each day its number was due and its asset read, once."""
    monkeypatch.setattr(maintenance, "FEW_DAYS", few)
    rows = random_rows(seed)
    fact = maintenance_fact(rows)
    category = lambda r: r["asset_category"] or "Unknown Category"
    readings = {(category(r), r["asset_code"], r["date"]) for r in rows
                if r["source"] == "hm_record" and r["asset_code"] and r["date"]}
    used = {tuple(category(r) if k == "asset_category" else r[k] for k in maintenance.consumption_keys())
            for r in rows if r["source"] == "good_consume"}
    events = {(r["consume_id_assignment"], r["due_date"], r["fix_hm_record"]) for r in rows
              if r["source"] == "good_consume" and r["consume_id_assignment"] is not None and r["due_date"]}
    expected = Counter()
    for key in used:
        of = dict(zip(maintenance.consumption_keys(), key))
        if None not in key:
            expected.update((*key, due.date()) for number, due, _ in events for c, a, at in readings
                            if number == of["consume_id_good_consume"] and at.date() == due.date()
                            and (c, a) == (of["asset_category"], of["asset_code"]))
    read = maintenance.reading_days(maintenance.hour_readings(fact))
    found = maintenance.matched_services(shaping.cost_rows(fact), read).collect()
    assert expected == {(*[r[k] for k in maintenance.consumption_keys()], r["due_day"]): r["pairs"] for r in found}
    assert len(found) == len(expected) > 5


@pytest.mark.parametrize("rows, stretches", [(0, 3), (1, 3), (97, 1), (97, 8), (97, 60)])
def test_page_directory(spark, rows, stretches):
    frame = spark.range(rows).select(
        F.when(F.col("id") % 9 > 0, F.col("id") * 31 % 10).alias("a"), F.concat(F.lit("r"), "id").alias("b"))
    order = [("a", False), ("b", True)]
    directory = paging.PageDirectory(frame, order, stretches)
    whole = [tuple(r) for r in paging.page(frame, order, max(rows, 1)).collect()]
    assert directory.counts(10) == (rows, -(-rows // 10))
    for number in range(-(-rows // 10) + 1):
        found = directory.page(10, number).collect()
        assert [tuple(r)[:-1] for r in found] == whole[number * 10:number * 10 + 10]
        assert [r["pos"] for r in found] == [*range(1, len(found) + 1)]


def test_deep_page_reads_as_little_as_the_first(spark):
    directory = paging.PageDirectory(spark.range(100_000), [("id", True)], 20)
    for number in (0, 4_990):
        page = directory.page(20, number)
        assert page.count() == 20
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "stretch" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_detail_pages_by_number(star_history):
    pages = plan.DetailPages(star_history, stretches=7)
    assert pages.counts() == (4205, 211)
    for number in (0, 100, 210):
        assert sorted(map(str, pages.page(number).collect())) == sorted(
            map(str, plan.detail_page(star_history, number).collect()))
