import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veritable.session import configure, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return configure(local_session(8, "tests"))


@pytest.fixture
def shuffled(spark):
    """Rows of a frame in other partitions and another order, for results that must not care."""

    def deal(df, parts):
        return df.repartition(parts)

    return deal
