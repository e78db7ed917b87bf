import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers start with this path.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""
    schema = "doc_id bigint, text string, lang string, score double, n_words bigint, row string"
    return lambda rows: spark.createDataFrame([(i, t, "en", 0.5, 7, "r") for i, t in rows], schema)
