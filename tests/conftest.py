import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemill.session import local_session

    made = local_session("4", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
                         spark__ui__showConsoleProgress="false")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def column(df, name, order="i"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]
