import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from acqlens.plans.session import build_session, checkpoint_dir

    s = build_session("local[4]", app_name="acqlens-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
    s.stop()
