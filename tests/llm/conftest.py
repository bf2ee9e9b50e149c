import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def texts(spark):
    """The suite's session, with fewer partitions: the tables here are tiny."""
    from detframe.llm.common import visible

    spark.conf.set("spark.sql.shuffle.partitions", "3")
    visible(spark)
    return spark
