"""Every registered query with reference SQL gives the same rows as DuckDB, on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from compare import connect, differences

from airgrid.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
CHECKED = [n for n, q in REGISTRY.items() if q.sql]


@pytest.fixture(scope="module")
def results(spark):
    """All comparisons, several queries at a time, as small queries leave most cores idle."""
    duck = connect(SMALL)

    def check(name):
        q = REGISTRY[name]
        try:
            return differences(q.run(spark, SMALL).toPandas(), duck.cursor().sql(q.sql).df())
        except Exception as error:  # noqa: BLE001 - reported by the query's own test
            return f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(CHECKED, pool.map(check, CHECKED)))


@pytest.mark.parametrize("name", CHECKED)
def test_query(results, name):
    assert results[name] is None


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in entry.queries()
