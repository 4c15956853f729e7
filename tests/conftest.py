import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from taxonspark.session import get_session, use_checkpoint_dir
    s = get_session(master="local[4]", conf={"spark.sql.shuffle.partitions": "8"})
    s.sparkContext.setLogLevel("ERROR")
    # tests only: the cluster would name a shared folder in spark.checkpoint.dir
    use_checkpoint_dir(s, tempfile.mkdtemp(prefix="taxonspark-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
