import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from mountwait.session import build_session
    scratch = tempfile.mkdtemp(prefix="mountwait-tests-")
    s = build_session("local[4]", 8, extra={
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.driver.memory": "4g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="mountwait-t-")
