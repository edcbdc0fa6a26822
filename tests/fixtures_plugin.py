from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from causeway.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Groups are cut into many buckets inside the test, so that carries and copies count."""
    spark.conf.set("spark.causeway.orderBuckets", "50")
    spark.conf.set("spark.causeway.bucketDays", "3")
    yield
    spark.conf.unset("spark.causeway.orderBuckets")
    spark.conf.unset("spark.causeway.bucketDays")


def rows(df, *order):
    """Rows as plain tuples, sorted by the given columns or by everything."""
    data = [tuple(r) for r in df.select(*order, *[c for c in df.columns if c not in order]).collect()]
    return sorted(data, key=repr)
