import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tabscore.session import build_session
    ckpt = tempfile.mkdtemp(prefix="tabscore-test-ckpt-")
    s = build_session("local[*]", app="tabscore-tests", shuffle_partitions=8,
                      conf={"spark.checkpoint.dir": ckpt,
                            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tabscore-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tabscore-t-")
