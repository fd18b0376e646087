import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function on Python values: one(function, value, ...) or a list of rows."""
    from pyspark.sql import functions as F

    def run(function, values, kinds="string"):
        names = [f"c{k}" for k in range(len(kinds.split(";")))]
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(";")))
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"row_no int, {schema}")
        return [r["x"] for r in frame.select("row_no", function(*[F.col(n) for n in names]).alias("x")).orderBy("row_no").collect()]

    return run
