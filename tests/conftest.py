import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

SF = os.environ.get("SPARKTILE_SF", "0.001")
SF_DIR = f"/root/testdata/sf{SF}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparktile.session import get_spark

    s = get_spark("tests", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("file:" + str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
