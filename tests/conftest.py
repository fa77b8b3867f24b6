from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from harvest.session import get_spark

    s = get_spark("harvest-tests", master="local[4]", shuffle_partitions=4, warehouse=str(tmp_path_factory.mktemp("warehouse")))
    yield s
    s.stop()
