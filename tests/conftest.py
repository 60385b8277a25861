import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from skycat.session import local_session

    s = local_session("*", shuffle_partitions=8, app="skycat-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skycat-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)


SF_SMALL = "/root/testdata/sf0.001"
