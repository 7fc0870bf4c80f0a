import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import clean_scratch, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=4, memory="6g")
    yield s
    clean_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
