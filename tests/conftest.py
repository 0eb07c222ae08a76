import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sifter.session import build_session
    s = build_session("local[4]", app_name="sifter-tests", shuffle_partitions=4,
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="sifter-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="sifter-test-")


def canon(spark, rows, features_schema="amount double, count long"):
    """Canonical records from (entity_id, timestamp, features-tuple) rows."""
    return spark.createDataFrame(
        [(e, t, f, {}) for e, t, f in rows],
        f"entity_id string, timestamp string, features struct<{features_schema}>, "
        "metadata map<string,string>")
