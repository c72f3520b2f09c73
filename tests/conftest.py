import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("millrace-tests", cpus="8", shuffle_partitions=4, driver_memory="6g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture()
def scratch(spark):
    from millrace.session import scratch_path
    return lambda name="t": scratch_path(spark, name)
