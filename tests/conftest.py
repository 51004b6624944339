import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from airgrid.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("airgrid-tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Build (station, time, v) from {station: values}, hourly from 2024-01-01."""

    def build(values: dict, start: str = "2024-01-01", columns: str = "v DOUBLE"):
        import datetime as dt

        t0 = dt.datetime.fromisoformat(start)
        rows = [(s, t0 + dt.timedelta(hours=i), x) for s, xs in values.items() for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, f"station STRING, time TIMESTAMP_NTZ, {columns}")

    return build


def column(df, name="v", by=("station", "time")):
    return [r[name] for r in df.orderBy(*by).collect()]
