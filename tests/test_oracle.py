"""Every registered query beside its oracle SQL on the small tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from pagetrace.suite.registry import registered
from tests.oracle import ROOT, compare, connect

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def outcomes(spark):
    """All comparisons, several at a time: the tables are too small to fill the cores."""
    con = connect(FOLDER)

    def run(item):
        name, (fn, sql) = item
        try:
            return name, compare(spark, con.cursor(), FOLDER, fn, sql)[0]
        except Exception as error:
            return name, f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(run, registered().items()))


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_oracle(outcomes, name):
    assert outcomes[name] in (None, "both empty")
