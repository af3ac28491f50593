import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from postloom.session import local_session

    s = local_session(4, partitions=2, memory="4g")
    # tiny tables: compiling and re-planning would take most of the time
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture()
def rows(spark):
    """rows(list of tuples, schema) -> DataFrame; an empty list is an empty table."""
    return lambda data, schema: spark.createDataFrame(data, schema)
