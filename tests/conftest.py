import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from binweave.session import session

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    s = session("local[8]", 4, "6g")
    yield s
    s.stop()
