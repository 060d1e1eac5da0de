import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.operators.ordered import BLOCK_ROWS_KEY  # noqa: E402
from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tickloom-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Make every symbol above ``n`` rows a hot one for the length of a test."""

    def use(n: int) -> None:
        spark.conf.set(BLOCK_ROWS_KEY, str(n))

    yield use
    spark.conf.unset(BLOCK_ROWS_KEY)
