import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from traymetrics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", 4, str(tmp_path_factory.mktemp("scratch")))
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data must still span chunks
    s.sparkContext.setLogLevel("ERROR")
    yield s
