import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from msgscreen.session import local_session
    s = local_session("*", shuffle_partitions=8, app="msgscreen-tests", checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
