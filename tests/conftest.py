import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def grid(spark, rows, raster_id="r"):
    """Cells of a list of rows; None is no data."""
    cells = [(raster_id, r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "raster_id string, row int, col int, value double")


def values(df, value="value"):
    """Rows of a grid's values."""
    found = {(r["row"], r["col"]): r[value] for r in df.collect()}
    rows, cols = (max((k[i] for k in found), default=-1) + 1 for i in (0, 1))
    return [[found.get((r, c)) for c in range(cols)] for r in range(rows)]
