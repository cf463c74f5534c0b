import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from barloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8, "barloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Build (sym, pos, d, x) rows from {sym: [values]}."""

    def build(data, name="x"):
        start = dt.date(2020, 1, 1)
        rows = [(s, i + 1, start + dt.timedelta(days=i), None if v is None else float(v)) for s, vs in data.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, f"sym string, pos int, d date, {name} double")

    return build
