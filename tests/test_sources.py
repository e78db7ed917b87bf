"""Reading, checking and staging."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from fleetmeter.fixed_values import COST_SOURCE
from fleetmeter.schema import MAINTENANCE_SCHEMA, TREND_SCHEMA
from fleetmeter.sources import readers, shaping, staging
from fleetmeter.sources.star import star_fact
from tests.conftest import FOLDER


def test_scans(spark, tmp_path):
    path = str(tmp_path / "fact")
    star_fact(spark, FOLDER).write.partitionBy("source").parquet(path)
    trend = readers.read_trend_fact(spark, path)
    assert "asset_name" in trend.columns and trend.count() == 6000 + 6000
    fact = readers.read_maintenance_fact(spark, path)
    assert fact.columns == MAINTENANCE_SCHEMA.names
    costs = shaping.cost_rows(fact).select("asset_code")
    plan = costs._jdf.queryExecution().executedPlan().toString()
    assert f"(source#" in plan and f"= {COST_SOURCE})" in plan.split("PartitionFilters")[1]
    assert "ReadSchema: struct<asset_code:string>" in plan
    assert costs.count() == 6000


def test_nan_becomes_null_and_numbers_are_cast(spark):
    row = ("hm_record", "C", "X", datetime.datetime(2024, 1, 1), None, float("nan"), 3, "true")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in TREND_SCHEMA]
    kinds[6] = "hour_meter_per_date int"
    read = readers.conform(spark.createDataFrame([row], ", ".join(kinds)), TREND_SCHEMA).first()
    assert read["total_price"] is None and read["hour_meter_per_date"] == 3.0


def test_wrong_inputs_are_errors(spark):
    fact = star_fact(spark, FOLDER)
    with pytest.raises(ValueError, match="missing"):
        readers.conform(fact.drop("reset_hm"), TREND_SCHEMA)
    with pytest.raises(ValueError, match="wrong type"):
        readers.conform(fact.withColumn("date", F.lit("x")), TREND_SCHEMA)


def test_csv_subset(spark, tmp_path):
    path = str(tmp_path / "csv")
    fact = readers.conform(star_fact(spark, FOLDER), MAINTENANCE_SCHEMA)
    fact.write.option("header", True).csv(path)
    columns = ["date", "product_id", "total_price"]
    read = readers.read_csv_subset(spark, path, columns)
    assert read.columns == columns
    assert read.exceptAll(fact.select(*columns)).count() == 0 and read.count() == fact.count()


def test_sql_text(spark):
    fact = star_fact(spark, FOLDER)
    found = readers.run_query(spark, "SELECT count(*) AS n FROM {f} WHERE source = 'hm_record'", f=fact)
    assert found.first()["n"] == 6000


def test_union_fills_missing_columns(spark):
    union = shaping.union_sources(spark.range(1).select(F.lit(1).alias("a")),
                                  spark.range(1).select(F.lit(2).alias("b")))
    rows = {r["source"]: (r["a"], r["b"]) for r in union.collect()}
    assert rows == {"hm_record": (1, None), "good_consume": (None, 2)}
    assert shaping.hour_rows(union).count() == 1


def test_staging_ends_lineage(spark):
    frame = staging.staged(spark.range(5), "numbers")
    assert frame.count() == 5
    assert staging.staging_folder(spark) in frame.inputFiles()[0]


def test_temporary_tables_go(spark, tmp_path):
    result = str(tmp_path / "result")
    with staging.temporary_tables(spark) as folder:
        kept = staging.staged(spark.range(10), "numbers")
        with staging.temporary_tables(spark) as inner:
            assert inner.startswith(folder)
            staging.staged(spark.range(3), "more").write.parquet(result)
        files = kept.inputFiles()
        assert files and all(folder.removeprefix("file:") in f for f in files) and kept.count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
    assert spark.read.parquet(result).count() == 3
    assert not staging.staging_path(spark, "x").startswith(folder)


def test_a_write_ends_with_its_shuffle_files(spark):
    def on_disk():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = on_disk()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("key")).agg(F.max("id").alias("most"))
    kept = staging.staged(rows.repartitionByRange(3, "most"), "numbers")
    until = time.time() + 10
    while on_disk() - before and time.time() < until:  # the executors' answer is not waited for
        time.sleep(0.1)
    assert not on_disk() - before
    assert kept.count() == 7
    assert spark.conf.get(staging.SHUFFLES_REMOVED, None) is None


@pytest.mark.parametrize("folders", [0, 2, 9])
def test_folders_written_side_by_side(spark, folders):
    """Also where a task has rows of more folders than may be open."""
    rows = spark.range(100, numPartitions=2).select("id", F.nullif(F.col("id") % 5, F.lit(4)).alias("kind"))
    kept = staging.staged(rows, "kinds", by=["kind"], folders=folders)
    assert sorted(map(str, kept.select("id", "kind").collect())) == sorted(map(str, rows.collect()))
    assert len({f.rsplit("/", 2)[1] for f in kept.inputFiles()}) == 5
    assert spark.conf.get(staging.SIDE_BY_SIDE) == "0"


def test_what_leads_to_a_table_goes(spark):
    with staging.temporary_tables(spark) as folder:
        steps = []
        kept = staging.staged_alone(spark, "kept", lambda: steps.append(staging.staged(spark.range(5), "step")) or steps[0])
        assert kept.count() == 5 and folder.removeprefix("file:") in kept.inputFiles()[0]
        with pytest.raises(Exception):
            steps[0].count()


def test_rewritten_tables_are_another_version(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(5).write.parquet(path)
    first = staging.files_version(spark, [path])
    assert first == staging.files_version(spark, [path])
    spark.range(6).write.mode("overwrite").parquet(path)
    assert first != staging.files_version(spark, [path])


class _Cluster:
    """Stands for a session on a cluster with the given settings."""

    def __init__(self, **settings):
        self.sparkContext = type("Context", (), {"master": "spark://host:7077"})
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: settings.get(key.split(".")[1], default)})()


def test_cluster_needs_a_stated_folder():
    import os
    assert staging.staging_folder(_Cluster(checkpoint="hdfs://x/c/")) == "hdfs://x/c"
    assert staging.staging_folder(_Cluster(sql="hdfs://x/w")) == "hdfs://x/w"
    with pytest.raises(RuntimeError):
        staging.staging_folder(_Cluster(sql=f"file:{os.getcwd()}/spark-warehouse"))


@pytest.fixture(scope="module")
def laid_out(spark):
    from fleetmeter.sources.layout import write_fact
    name = "fact_by_asset"
    assert write_fact(readers.conform(star_fact(spark, FOLDER), MAINTENANCE_SCHEMA), name, 4)
    yield readers.read_maintenance_fact(spark, name, fmt="table")
    spark.sql(f"DROP TABLE {name}")


def _exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_grouping_by_asset_needs_no_shuffle(spark, laid_out):
    from fleetmeter.operators import maintenance
    fact = readers.conform(star_fact(spark, FOLDER), MAINTENANCE_SCHEMA)
    views = [maintenance.hour_readings, maintenance.latest_readings,
             lambda rows: maintenance.reading_days(maintenance.hour_readings(rows)),
             lambda rows: maintenance.consumption(shaping.cost_rows(rows))]
    for view in views:
        assert _exchanges(view(laid_out)) == 0 < _exchanges(view(fact))
        assert view(laid_out).exceptAll(view(fact)).isEmpty() and view(fact).exceptAll(view(laid_out)).isEmpty()


def test_one_source_and_a_range_of_dates_reach_the_scan(laid_out):
    from fleetmeter.operators import predicates
    rows = shaping.hour_rows(laid_out).where(predicates.within_days("date", "1996-01-01", "1996-03-31"))
    scan = next(line for line in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line)
    assert "source" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date" in scan and "LessThan(date" in scan


def test_a_hot_asset_is_not_bucketed(spark):
    from fleetmeter.sources.layout import write_fact
    fact = readers.conform(star_fact(spark, FOLDER), MAINTENANCE_SCHEMA)
    hot = fact.withColumn("asset_code", F.when(F.col("product_bought_qty") > 10, "X").otherwise(F.col("asset_code")))
    assert not write_fact(hot, "fact_by_date", 16)
    try:
        table = readers.read_maintenance_fact(spark, "fact_by_date", fmt="table")
        assert table.exceptAll(hot).isEmpty() and hot.exceptAll(table).isEmpty()
    finally:
        spark.sql("DROP TABLE fact_by_date")


def test_no_rows_are_laid_out(maintenance_fact, spark):
    from fleetmeter.sources.layout import write_fact
    assert write_fact(maintenance_fact([]), "fact_of_nothing", 3)
    assert spark.table("fact_of_nothing").count() == 0
    spark.sql("DROP TABLE fact_of_nothing")
