import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import tavola  # noqa: E402, F401  (before numpy: it sets the number of BLAS threads)


@pytest.fixture(scope="session")
def spark():
    from tavola.session import get_spark
    s = get_spark("local[4]", 8, app_name="tavola-tests")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
