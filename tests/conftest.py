import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetmeter.schema import MAINTENANCE_SCHEMA, TREND_SCHEMA  # noqa: E402
from fleetmeter.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", 4,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
         "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _rows(spark, schema, rows):
    return spark.createDataFrame([[row.get(f.name) for f in schema] for row in rows], schema)


@pytest.fixture
def trend_fact(spark):
    return lambda rows: _rows(spark, TREND_SCHEMA, rows)


@pytest.fixture
def maintenance_fact(spark):
    return lambda rows: _rows(spark, MAINTENANCE_SCHEMA, rows)
