import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evtab.session import build_session, checkpoint_dir
    s = build_session("local[4]", shuffle_partitions=8, app_name="evtab-tests")
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="evtab-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="evtab-test-")


SMALL_SF = "/root/testdata/sf0.001"
