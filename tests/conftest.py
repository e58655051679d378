import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quoteflow.session import get_session

    scratch = tempfile.mkdtemp(prefix="quoteflow-test-")
    s = get_session("local[4]", 8, app_name="quoteflow-tests", extra={
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.sql.streaming.checkpointLocation": os.path.join(scratch, "stream-ckpt"),
        "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="quoteflow-test-data-")
