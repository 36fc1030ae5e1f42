import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from gradebook.session import SCALE_DEFAULTS

    b = (SparkSession.builder.master("local[4]").appName("gradebook-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "4g"))
    for k, v in SCALE_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests only: a private checkpoint folder when the session names none
    # (spark.checkpoint.dir is static, so only the SparkContext folder is set).
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gradebook-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_(tmp_path):
    return str(tmp_path)
