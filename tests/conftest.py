import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from funclab.session import session  # noqa: E402


@pytest.fixture(autouse=True, scope="module")
def functions_of_tests_travel(request):
    """Python workers cannot import test modules."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(request.module)
    yield
    cloudpickle.unregister_pickle_by_value(request.module)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    }
    spark = session("tests", "local[4]", **settings)
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture
def clean(spark):
    """A small clean table: 120 rows in two languages, one of them lopsided."""
    rows = [
        (i, "kotlin" if i % 3 else "rust", f"fun f{i}() {{\n  x = {i}\n}}", int(i % 7 == 0), "1", f"  x = {i}", "plain")
        for i in range(120)
    ]
    schema = (
        "row_id long, language string, processed_func string, target int, flaw_line_index string, "
        "flaw_line string, configuration string"
    )
    return spark.createDataFrame(rows, schema)
