import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import MESSY, SCHEMA, document  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(MESSY, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    return lambda rows, parts=3: spark.createDataFrame([document(*r) for r in rows], SCHEMA).repartition(parts)
