import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tests_llm_rows import CLASHES, ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
