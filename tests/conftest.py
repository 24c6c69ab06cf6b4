from __future__ import annotations

import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from seriesloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests", cores="8", shuffle_partitions=4, **{"spark.checkpoint.dir": str(shared)}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def obs(spark):
    """Observations from (series, day text, value) tuples."""
    def make(rows):
        df = spark.createDataFrame(rows, "series_id string, d string, value double")
        return df.select("series_id", F.to_date("d").alias("obs_date"), "value")

    return make


@pytest.fixture(scope="session")
def daily(obs):
    """A series of values on consecutive days from a start."""
    def make(values, start="2024-01-01", series="s", step=1):
        from datetime import timedelta

        first = date.fromisoformat(start)
        return obs(
            [
                (series, (first + timedelta(days=i * step)).isoformat(), None if v is None else float(v))
                for i, v in enumerate(values)
            ]
        )

    return make


def rows(df, *columns):
    """Rows as dicts, sorted by the given columns."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in columns)) if columns else out


def one(df):
    found = rows(df)
    assert len(found) == 1, found
    return found[0]
