import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    base = tmp_path_factory.mktemp("spark")
    session = local_session("tests", int(os.environ.get("TEST_CPUS", "8")), 4, **{"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "shared")})
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF
