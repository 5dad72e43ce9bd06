import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repocensus.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def files(spark):
    """files({path: content}) or files([(repo, path, content), ...]) as a FILES frame."""
    from repocensus.schemas import FILES

    def make(rows):
        if isinstance(rows, dict):
            rows = [("repo", path, content) for path, content in rows.items()]
        return spark.createDataFrame([(*r, None) for r in rows], FILES)

    return make
