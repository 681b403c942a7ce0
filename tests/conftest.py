from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dueline import CaseLog, EventLogSpec  # noqa: E402
from dueline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SMALL = EventLogSpec(
    case="case_id", activity="activity", timestamp="ts", resource=None, order_by=("ts", "nr")
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make_log(spark):
    """Log from rows (case, activity, time) in their order; `nr` breaks ties."""

    def make(rows, extra="", spec=SMALL, **changes):
        data = [(c, a, None if t is None else at(t), i, *more) for i, (c, a, t, *more) in enumerate(rows)]
        schema = "case_id string, activity string, ts timestamp_ntz, nr int" + (
            f", {extra}" if extra else ""
        )
        return CaseLog.of(spark.createDataFrame(data, schema), spec.but(**changes))

    return make


def values(df, *names):
    picked = df.select(*[f"`{n}`" for n in names]) if names else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
