import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from priorline.session import build_session

    root = tmp_path_factory.mktemp("spark")
    s = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{root}/checkpoints",
            "spark.sql.warehouse.dir": f"{root}/warehouse",
            "spark.local.dir": f"{root}/local",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
