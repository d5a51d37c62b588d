import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lethe.session import build_session
    s = build_session("local[*]", app="lethe-tests", shuffle_partitions=8,
                      extra={"spark.ui.enabled": "false", "spark.driver.memory": "6g",
                             "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    # the checkpoint root comes from spark.checkpoint.dir; where that is
    # unset, checkpoint_root picks a scratch folder for the test run
    from lethe.session import checkpoint_root
    checkpoint_root(s)
    yield s
    from lethe.session import release
    release(s)
    s.stop()


@pytest.fixture(scope="session")
def fixtures(spark):
    from lethe.sources.fixtures import FixtureModel
    return FixtureModel(spark)


@pytest.fixture(scope="session")
def model(spark):
    from lethe.sources.derived import ComplianceModel
    return ComplianceModel(spark, SF_SMALL)
