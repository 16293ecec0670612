"""One small session for all tests."""

from __future__ import annotations

import pytest

from weftline.session import build_session


@pytest.fixture(scope="session")
def spark():  # noqa: ANN201
    s = build_session("weftline-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    return s
