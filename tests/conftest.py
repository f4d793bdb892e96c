import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from reelmill.session import build_session

    session = build_session("tests", "local[8]", **{"spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": "/tmp/reelmill-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
