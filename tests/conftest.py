import pytest

from pagetrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", name="pagetrace-tests", **{"spark.sql.shuffle.partitions": "4"})
