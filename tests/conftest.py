import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wayfare.session import get_spark

    ckpt = tempfile.mkdtemp(prefix="wayfare-test-ckpt-")
    s = get_spark("local[4]", 8, app_name="wayfare-tests",
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="wayfare-test-")
