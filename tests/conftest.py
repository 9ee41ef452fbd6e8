import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridpace.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def ctx(spark):
    from gridpace.registry import Context
    return Context.of(spark, SF)
