import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TALLYLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import session

    return session("tests", cores=4, partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
