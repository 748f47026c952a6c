import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _fresh_dir(prefix: str) -> str:
    return subprocess.check_output(["mktemp", "-d", f"/tmp/{prefix}-XXXXXX"], text=True).strip()


@pytest.fixture(scope="session")
def spark():
    from cardflow.session import build_session
    s = build_session("local[*]", app_name="cardflow-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    # tests own their shared folder only when the session names none
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", _fresh_dir("ckpt"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return _fresh_dir("cardflow-test")


SF001 = "/root/testdata/sf0.001"
