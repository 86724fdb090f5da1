import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


from pyspark.sql import SparkSession  # noqa: E402

from playbill.session import configure  # noqa: E402


def _session():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="playbill-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return configure(session)


# Started before the test modules load, as they build Column expressions at module level.
_SPARK = _session()


@pytest.fixture(scope="session")
def spark():
    return _SPARK


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of Column expressions over rows of one string column ``c``."""

    def run(values, *columns):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        rows = df.select("i", *[c.alias(f"r{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
        return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]

    return run
