import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gridlens.session import get_spark
    os.environ.setdefault("GRIDLENS_TEST_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="gridlens-test-chk-"))
    s = get_spark("local[4]", "gridlens-tests", shuffle_partitions=8)
    yield s
    s.stop()
